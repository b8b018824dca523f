"""Side sets beside their parent elements: both tables in buckets of the same key, so that joins between them move nothing.

Owners follow from an element's place in its block, so a side set is routed without looking at the elements; what is written
once in buckets serves every later join on the parent without a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..storage import shared_dir
from .partition import part_of

#: Elements of a bucket where the caller names no number of buckets.
BUCKET_ELEMENTS = 1 << 22


def bucketed(df: DataFrame, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """df as a table of the session in the shared folder, in buckets by the keys and sorted by them, one file a bucket."""
    spark, name = df.sparkSession, f"tessella_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/tessella/{name}").saveAsTable(name)
    return spark.table(name)


def _sizes(mesh: Mesh) -> dict[int, int]:
    """Elements of each block: a row a block."""
    return {r.block_id: r.n for r in mesh.elements.groupBy("block_id").agg(F.count("*").alias("n")).collect()}


def _owned(index, block, sizes: dict[int, int], parts: int):
    """The part of an element of a block, and its place in the part's run; null for an element that the block doesn't have."""
    part, local = F.lit(None).cast("int"), F.lit(None).cast("long")
    for b, n in sizes.items():
        mine = (block == b) & index.between(0, n - 1)
        owner = part_of(index, n, parts)
        first = owner.cast("long") * (n // parts) + F.least(owner, F.lit(n % parts))
        part, local = F.when(mine, owner).otherwise(part), F.when(mine, index - first).otherwise(local)
    return part, local


def element_table(mesh: Mesh, parts: int, buckets: int | None = None) -> DataFrame:
    """block_id, elem_id, part, local_id, nodes, in buckets by (block_id, elem_id): every block's elements are dealt out in
    runs as in `element_parts`, local_id counts from the run's first. Elements of a block have to be numbered 0..n-1."""
    sizes = _sizes(mesh)
    part, local = _owned(F.col("elem_id").cast("long"), F.col("block_id"), sizes, parts)
    rows = mesh.elements.select(F.col("block_id").cast("int").alias("block_id"), F.col("elem_id").cast("long").alias("elem_id"), part.alias("part"), local.alias("local_id"), "nodes")
    return bucketed(rows, ("block_id", "elem_id"), buckets or max(1, -(-sum(sizes.values()) // BUCKET_ELEMENTS)))


def side_table(sideset: DataFrame, buckets: int) -> DataFrame:
    """A side set (parent, lfi, block_id and any more) in as many buckets by (block_id, parent) as its `element_table` has."""
    rest = [c for c in sideset.columns if c not in ("block_id", "parent")]
    rows = sideset.select(F.col("block_id").cast("int").alias("block_id"), F.col("parent").cast("long").alias("parent"), *rest)
    return bucketed(rows, ("block_id", "parent"), buckets)


def beside_parents(sides: DataFrame, elements: DataFrame) -> DataFrame:
    """part, block_id, parent, lfi, local_parent, nodes (the parent's): each side of a `side_table` with its parent's row of the
    `element_table`. Both lie in equal buckets, so nothing is exchanged. Repeated sides stay; a side whose parent isn't there is
    an error when its row is read."""
    own = elements.select(F.col("block_id").alias("_block"), F.col("elem_id").alias("_elem"), "part", "local_id", "nodes")
    met = sides.hint("merge").join(own, (sides["block_id"] == own["_block"]) & (sides["parent"] == own["_elem"]), "left")
    missing = F.raise_error(F.format_string("block %d has no element %d, which a side names", "block_id", "parent"))
    return met.select(F.when(F.col("_elem").isNull(), missing.cast("int")).otherwise(F.col("part")).alias("part"), "block_id", "parent", "lfi", F.col("local_id").alias("local_parent"), "nodes")


def redistributed(mesh: Mesh, sideset: DataFrame, parts: int, buckets: int | None = None) -> DataFrame:
    """A side set dealt out over its parents' parts: `beside_parents` of both tables, written in buckets first."""
    n = buckets or max(1, -(-mesh.n_elements() // BUCKET_ELEMENTS))
    elements = element_table(mesh, parts, n)
    return beside_parents(side_table(sideset, n), elements)
