"""Partition, halo and packing reports: what a distribution over parts would look like, as pure DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elem_types import element_type
from ..mesh import Mesh
from ..storage import materialize


def part_start(n: int, parts: int, part: int) -> int:
    """First index of a part where 0..n-1 is dealt out in runs and the first n % parts parts get one more."""
    return part * (n // parts) + min(part, n % parts)


def part_size(n: int, parts: int, part: int) -> int:
    return n // parts + (part < n % parts)


def part_of(index: Column, n: int, parts: int) -> Column:
    """The part of an index under the same rule."""
    small, more = n // parts, n % parts
    head = more * (small + 1)
    div = lambda a, b: F.call_function("div", a, F.lit(max(1, b)))
    return F.when(index < head, div(index, small + 1)).otherwise(div(index - head, small) + more).cast("int")


def element_parts(mesh: Mesh, parts: int) -> DataFrame:
    """elem_id, part of a single-block mesh."""
    n = mesh.n_elements()
    return mesh.elements.select("elem_id", part_of(F.col("elem_id"), n, parts).alias("part"))


def node_parts(mesh: Mesh, owners: DataFrame) -> DataFrame:
    """part, node_id, owner, class: every node of each part's elements. Its owner is the lowest part that has it;
    classes: 0 owned by this part alone, 1 owned and shared, 2 ghost."""
    at = mesh.elements.join(owners, "elem_id").select("part", F.explode("nodes").alias("node_id")).distinct()
    own = at.groupBy("node_id").agg(F.min("part").alias("owner"), F.max("part").alias("last"))
    joined = at.join(own, "node_id")
    kind = F.when(F.col("part") != F.col("owner"), 2).when(F.col("last") > F.col("owner"), 1).otherwise(0)
    return joined.select("part", "node_id", "owner", kind.alias("class"))


def local_nodes(nodes: DataFrame) -> DataFrame:
    """... with local_id: by class, then global id, within each part."""
    return nodes.withColumn("local_id", F.row_number().over(W.partitionBy("part").orderBy("class", "node_id")) - 1)


def local_elements(mesh: Mesh, owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """part, elem_id, shared, local_id: elements that touch a node of another part come last."""
    foreign = nodes.where("class = 2").select("part", "node_id")
    long = mesh.elements.join(owners, "elem_id").select("part", "elem_id", F.explode("nodes").alias("node_id"))
    touched = long.join(foreign, ["part", "node_id"]).select("part", "elem_id").distinct().withColumn("shared", F.lit(True))
    rows = owners.join(touched, ["part", "elem_id"], "left").select("part", "elem_id", F.coalesce("shared", F.lit(False)).alias("shared"))
    return rows.withColumn("local_id", F.row_number().over(W.partitionBy("part").orderBy("shared", "elem_id")) - 1)


def aura_elements(mesh: Mesh, owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """part, elem_id, owner: elements of other parts around nodes that a part owns."""
    mine = nodes.where("class < 2").select("part", "node_id")
    around = mesh.elements.join(owners.withColumnRenamed("part", "elem_part"), "elem_id").select("elem_id", "elem_part", F.explode("nodes").alias("node_id"))
    return around.join(mine, "node_id").where("part <> elem_part").select("part", "elem_id", F.col("elem_part").alias("owner")).distinct()


def aura_nodes(mesh: Mesh, nodes: DataFrame, aura: DataFrame) -> DataFrame:
    """part, node_id, owner: nodes of aura elements that the part doesn't have yet."""
    owner = nodes.groupBy("node_id").agg(F.min("owner").alias("owner"))
    near = aura.join(mesh.elements, "elem_id").select("part", F.explode("nodes").alias("node_id")).distinct()
    return near.join(nodes.select("part", "node_id"), ["part", "node_id"], "left_anti").join(owner, "node_id").select("part", "node_id", "owner")


def owner_numbering(nodes: DataFrame) -> DataFrame:
    """node_id, new_id: owner by owner, in each by class and global id; offsets are running sums of the parts' counts."""
    mine = nodes.where("class < 2")
    counts = mine.groupBy("part").agg(F.count("*").alias("c"))
    # One row a part: the only window without a key.
    offsets = counts.select(F.col("part").alias("p"), (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("offset"))
    local = local_nodes(mine)
    return local.join(F.broadcast(offsets), F.col("part") == F.col("p")).select("node_id", (F.col("offset") + F.col("local_id")).alias("new_id"))


def halo(nodes: DataFrame, aura: DataFrame | None = None) -> DataFrame:
    """node_id, part, owner of every import (ghosts, and aura nodes where given)."""
    ghosts = nodes.where("class = 2").select("node_id", "part", "owner")
    return ghosts if aura is None else ghosts.unionByName(aura.select("node_id", "part", "owner"))


def scatter_add(local: DataFrame) -> DataFrame:
    """(part, node_id, comp, value) -> node_id, comp, value: contributions of all parts summed at the owner."""
    return local.groupBy("node_id", "comp").agg(F.sum("value").alias("value"))


def gather_owned(local: DataFrame, imports: DataFrame) -> DataFrame:
    """part, node_id, comp, value of every import, as its owner has it."""
    theirs = local.withColumnRenamed("part", "owner")
    return imports.join(theirs, ["node_id", "owner"]).select("part", "node_id", "comp", "value")


def partition_report(mesh: Mesh, parts: int) -> DataFrame:
    """part, elements, owned, shared, ghosts, aura_elements, aura_nodes."""
    owners = materialize(element_parts(mesh, parts))
    nodes = materialize(node_parts(mesh, owners))
    aura = materialize(aura_elements(mesh, owners, nodes))
    count = lambda df, name: df.groupBy("part").agg(F.count("*").alias(name))
    kinds = nodes.groupBy("part").agg(*[F.sum(F.when(F.col("class") == k, 1).otherwise(0)).alias(n) for k, n in enumerate(("owned", "shared", "ghosts"))])
    out = count(owners, "elements").join(kinds, "part", "left").join(count(aura, "aura_elements"), "part", "left").join(count(aura_nodes(mesh, nodes, aura), "aura_nodes"), "part", "left")
    return out.fillna(0)


def elements_per_pack(mesh: Mesh, max_nodes: int, n: int | None = None) -> int:
    """Packs of consecutive elements that can't hold more than max_nodes nodes on average: both sizes by whole ceilings."""
    n = mesh.n_elements() if n is None else n
    width = element_type(mesh.elem_type).n_nodes
    packs = max(1, -(-n * width // max_nodes))
    return max(1, -(-n // packs))


def packs(mesh: Mesh, per_pack: int) -> DataFrame:
    """elem_id, pack."""
    return mesh.elements.select("elem_id", F.call_function("div", F.col("elem_id"), F.lit(per_pack)).alias("pack"))


def packed_nodes(mesh: Mesh, per_pack: int) -> DataFrame:
    """pack, node_id, class, packed_id, local_id: a node belongs to the first pack that touches it (0 owned, 1 owned and
    shared); other packs see it as a ghost (2). Owned nodes are packed by pack, class and first touch (local node, then
    element); local ids count owned nodes first, then ghosts, each by first touch."""
    long = mesh.elements.select(F.call_function("div", F.col("elem_id"), F.lit(per_pack)).alias("pack"), "elem_id", F.posexplode("nodes").alias("lnode", "node_id"))
    seen = long.groupBy("pack", "node_id").agg(F.min(F.struct("lnode", "elem_id")).alias("touch"))
    own = seen.groupBy("node_id").agg(F.min("pack").alias("owner"), F.max("pack").alias("last"))
    rows = seen.join(own, "node_id").withColumn("class", F.when(F.col("pack") != F.col("owner"), 2).when(F.col("last") > F.col("owner"), 1).otherwise(0))
    rows = rows.withColumn("local_id", F.row_number().over(W.partitionBy("pack").orderBy("class", "touch")) - 1)
    counts = rows.where("class < 2").groupBy("pack").agg(F.count("*").alias("c"))
    from .numbering import dense_ids, running_total

    numbered = materialize(dense_ids(counts, ["pack"], "k"))
    starts = running_total(numbered, "k", "c").select(F.col("id").alias("k"), F.col("start").alias("offset"))
    offsets = numbered.join(starts, "k").select(F.col("pack").alias("op"), "offset")
    owned = rows.where("class < 2").join(offsets, F.col("pack") == F.col("op")).select(F.col("node_id").alias("on"), (F.col("offset") + F.col("local_id")).alias("packed_id"))
    return rows.join(owned, F.col("node_id") == F.col("on")).select("pack", "node_id", "class", "packed_id", "local_id")


def packed_elements(mesh: Mesh, per_pack: int) -> DataFrame:
    """pack, elem_id, nodes: connectivity in local ids, small enough for short integers."""
    local = packed_nodes(mesh, per_pack).select("pack", "node_id", "local_id")
    long = mesh.elements.select(F.call_function("div", F.col("elem_id"), F.lit(per_pack)).alias("pack"), "elem_id", F.posexplode("nodes").alias("lnode", "node_id"))
    by = long.join(local, ["pack", "node_id"]).groupBy("pack", "elem_id").agg(F.sort_array(F.collect_list(F.struct("lnode", "local_id"))).alias("x"))
    return by.select("pack", "elem_id", F.transform("x", lambda s: s["local_id"].cast("short")).alias("nodes"))


def ghost_reduction(packed: DataFrame) -> DataFrame:
    """packed_id, sources: where each owned node's ghosts lie (pack, local id)."""
    ghosts = packed.where("class = 2")
    return ghosts.groupBy("packed_id").agg(F.sort_array(F.collect_list(F.struct("pack", "local_id"))).alias("sources"))


def to_packed(field: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, value) by node -> by packed id."""
    return field.join(packed.where("class < 2").select(F.col("node_id").alias("id"), "packed_id"), "id").select(F.col("packed_id").alias("id"), "value")


def to_unpacked(field: DataFrame, packed: DataFrame) -> DataFrame:
    return field.join(packed.where("class < 2").select(F.col("packed_id").alias("id"), "node_id"), "id").select(F.col("node_id").alias("id"), "value")
