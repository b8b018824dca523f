"""Dense numbering without a single-partition window, and numbering by first touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import unfolded
from ..storage import materialize


def dense_ids(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """df with `name`: 0-based (from `start`) position in the order.

    Rows are range-partitioned and sorted; a row's number is its partition's offset plus its place there. Only one count
    a partition comes to the driver. The order must be total for the numbers to be unique to it. The ranged rows are
    written once, as a second sampling of the ranges could cut them elsewhere.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    fixed = materialize(ranged)
    part = F.shiftright("__at", 33)
    counts = {r.p: r.n for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], start
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    if not offsets:
        return fixed.drop("__at").withColumn(name, F.lit(None).cast("long"))
    table = df.sparkSession.createDataFrame(offsets, "__p long, __offset long")
    joined = fixed.join(F.broadcast(table), part == F.col("__p"))
    low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("__offset") + low).drop("__at", "__p", "__offset")


def first_touch(incidence: DataFrame, node: str = "node_id", by: tuple[str, ...] = ("block_id", "elem_id", "lnode")) -> DataFrame:
    """node_id, new_id: nodes numbered in the order in which elements name them first."""
    seen = incidence.groupBy(F.col(node).alias("node_id")).agg(F.min(F.struct(*by)).alias("first"))
    return dense_ids(seen, [F.col(f"first.{c}") for c in by], "new_id").select("node_id", "new_id")


def renumbered(elements: DataFrame, mapping: DataFrame, old: str = "node_id", new: str = "new_id") -> DataFrame:
    """elements with nodes replaced through the mapping."""
    long = elements.select("block_id", "elem_id", F.posexplode("nodes").alias("lnode", "node_id"))
    joined = unfolded(long).join(mapping.select(F.col(old).alias("node_id"), F.col(new).alias("new_id")), "node_id")
    return regathered(joined, "new_id")


def regathered(long: DataFrame, node: str = "node_id") -> DataFrame:
    """(block_id, elem_id, lnode, node) -> elements."""
    by = long.groupBy("block_id", "elem_id").agg(F.sort_array(F.collect_list(F.struct("lnode", F.col(node).alias("n")))).alias("x"))
    return by.select("block_id", "elem_id", F.transform("x", lambda s: s["n"]).alias("nodes"))


def running_total(counts: DataFrame, key: str, value: str) -> DataFrame:
    """id, start: for keys 0..n-1 the sum of `value` over smaller keys, and the total at n. Ranges of keys are summed first, so
    only a sum a range meets in one place; within a range a window runs."""
    from pyspark.sql import Window as W

    fixed = materialize(counts.select(F.col(key).alias("id"), F.col(value).alias("v"), F.shiftright(F.col(key).cast("long"), RANGE_BITS).alias("r")))
    ranges = fixed.groupBy("r").agg(F.sum("v").alias("s"), F.max("id").alias("last"))
    before = ranges.select("r", (F.sum("s").over(W.orderBy("r")) - F.col("s")).alias("before"), F.sum("s").over(W.orderBy("r")).alias("upto"), "last")
    before = materialize(before)
    inner = W.partitionBy("r").orderBy("id")
    starts = fixed.withColumn("own", F.sum("v").over(inner) - F.col("v")).join(F.broadcast(before), "r").select("id", (F.col("own") + F.col("before")).alias("start"))
    total = before.agg((F.max("last") + 1).alias("id"), F.max("upto").alias("start")).where("id is not null")
    return starts.unionByName(total)


#: Keys of a range of a running total.
RANGE_BITS = 16
