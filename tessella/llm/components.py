"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long) -> node, component (the smallest node reachable), for every node that has a link.

    Each step is a join and an aggregation with partial minima; no node's neighbours are gathered. Rounds grow with the
    logarithm of the longest chain; each is written to the shared folder.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        # Small star: a node and its smaller neighbours move to the smallest of them. A node with many hubs, as buckets
        # of one group have them, keeps one; the first round leaves little more than an edge a node.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
        # Large star: a node's larger neighbours move to the smallest one around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        small = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        new = materialize(small)
        # Done when every edge ends at a root: no node is both above and below.
        if not new.join(new.select(F.col("u").alias("r")).distinct(), F.col("v") == F.col("r"), "left_semi").limit(1).count():
            if not new.groupBy("u").count().where("count > 1").limit(1).count():
                edges = new
                break
        edges = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
