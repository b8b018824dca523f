"""Regions of graphs and surfaces: connected groups, patches between sharp edges, and what lies nearest along a graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elem_types import SIDES, corners, linear
from ..mesh import Mesh
from ..storage import materialize
from . import graph
from .numbering import dense_ids
from .sets import face_normals


class Groups(NamedTuple):
    members: DataFrame  # node, group: the smallest node that is reached; nodes without a link are left out
    rounds: int


def linked_groups(links: DataFrame) -> Groups:
    """links: a, b. Stars in turn: every node hands the smallest of its smaller neighbours to the others, then the smallest
    around it to its larger ones. Distances halve about every round, so rounds follow the logarithm of the longest path; a round is
    two aggregations and two joins of at most as many rows as there are links, written to the shared folder."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    rounds = 0
    while True:
        rounds += 1
        low = edges.groupBy("hi").agg(F.min("lo").alias("least"))
        handed = edges.join(low, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        edges = materialize(handed.unionByName(low.withColumnRenamed("least", "lo")).distinct())
        around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        low = around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        new = materialize(around.join(low, "node").where("other > node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct())
        # Stars are left when nothing that is pointed at points on, and every node points once.
        n, pointing, onward = new.count(), new.select("hi").distinct().count(), new.join(new.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        edges = new
        if n == pointing and not onward:
            break
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    return Groups(members.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("group")).distinct()), rounds)


def _edge_links(surface: Mesh) -> DataFrame:
    """block1, e1, block2, e2: surface elements that share an edge, both ways. Those around an edge meet in its row."""

    def rows(elements: DataFrame, t: str) -> DataFrame:
        at = corners(t)
        return graph.patterned(elements, tuple((at[i], at[j]) for i, j in SIDES[linear(t)]))

    keyed = graph.by_type(surface, rows).select("block_id", "elem_id", F.array_min("nodes").alias("i"), F.array_max("nodes").alias("j"))
    around = keyed.groupBy("i", "j").agg(F.collect_set(F.struct("block_id", "elem_id")).alias("m")).where(F.size("m") > 1)
    pairs = around.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where("x <> y").distinct()
    return pairs.select(F.col("x.block_id").alias("block1"), F.col("x.elem_id").alias("e1"), F.col("y.block_id").alias("block2"), F.col("y.elem_id").alias("e2"))


def smooth_links(surface: Mesh, threshold: float) -> DataFrame:
    """e1, e2 of a single-block surface: neighbours over an edge whose unit normals have an absolute cosine above the threshold."""
    axes = ("nx", "ny", "nz")
    normals = materialize(face_normals(surface).where("nx is not null").select("elem_id", *axes))
    one = normals.select(F.col("elem_id").alias("e1"), *[F.col(c).alias(f"a{c}") for c in axes])
    two = normals.select(F.col("elem_id").alias("e2"), *[F.col(c).alias(f"b{c}") for c in axes])
    cosine = F.abs(sum((F.col(f"a{c}") * F.col(f"b{c}") for c in axes), F.lit(0.0)))
    return _edge_links(surface).select("e1", "e2").where("e1 < e2").join(one, "e1").join(two, "e2").where(cosine > threshold).select("e1", "e2")


def surface_patches(surface: Mesh, threshold: float) -> DataFrame:
    """elem_id, patch: every element of a single-block surface with the smallest element that it reaches over smooth edges."""
    groups = linked_groups(smooth_links(surface, threshold).select(F.col("e1").alias("a"), F.col("e2").alias("b"))).members
    return surface.elements.select("elem_id").join(groups.withColumnRenamed("node", "elem_id"), "elem_id", "left").select("elem_id", F.coalesce("group", "elem_id").alias("patch"))


def _squared(point: tuple[float, ...]):
    return sum(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(p)) ** 2 for c, p in zip("xyz", point)), F.lit(0.0))


def select_surface(surface: Mesh, point: tuple[float, float, float], threshold: float) -> DataFrame:
    """elem_id: the patch of the element that has the nearest node to a point (of equally near ones the first)."""
    near = surface.incidence().join(surface.points, "node_id").groupBy("elem_id").agg(F.min(_squared(point)).alias("d2"))
    seed = near.orderBy("d2", "elem_id").limit(1).select("elem_id")
    patches = materialize(surface_patches(surface, threshold))
    return patches.join(patches.join(seed, "elem_id").select("patch"), "patch", "left_semi").select("elem_id")


def nodes_by_hops(links: DataFrame, seed: int, most: int) -> DataFrame:
    """node, level, place: the first `most` nodes that a queue from the seed meets over links (i, j, both ways): a level's
    nodes follow their first-met neighbour in the level before, then their own number.

    A level is a join of its rim and a dense numbering; the last one is cut by place, so the number is exact.
    """
    spark = links.sparkSession
    links = materialize(links.select("i", "j").where("i <> j"))
    rim = materialize(spark.createDataFrame([(seed, 0, 0)], "node long, level int, place long"))
    met, count, before = [rim], 1, rim.limit(0)
    while count < most:
        reached = links.join(rim.select(F.col("node").alias("i"), "place"), "i").groupBy("j").agg(F.min("place").alias("parent"))
        # What the rim reaches lies in it, in the level before, or is new.
        new = reached.join(rim.select(F.col("node").alias("j")), "j", "left_anti").join(before.select(F.col("node").alias("j")), "j", "left_anti")
        level = dense_ids(new, ["parent", "j"], "place", count).select(F.col("j").alias("node"), F.lit(len(met)).alias("level"), "place")
        level = materialize(level)
        n = level.count()
        if not n:
            break
        met.append(level)
        before, rim, count = rim, level, count + n
    out = met[0]
    for level in met[1:]:
        out = out.unionByName(level)
    return out.where(F.col("place") < most)


def nodes_around(mesh: Mesh, point: tuple[float, float, float], max_nodes: int, along: bool = False) -> DataFrame:
    """node_id: exactly max_nodes nodes (or all that there are) nearest to a point, in space or, `along`, by edges and shared
    elements from the node that is nearest."""
    ranked = mesh.points.select("node_id", _squared(point).alias("d2"))
    if not along:
        return ranked.orderBy("d2", "node_id").limit(max_nodes).select("node_id")
    first = ranked.orderBy("d2", "node_id").first()
    if first is None or max_nodes < 1:
        return ranked.select("node_id").limit(0)
    return nodes_by_hops(graph.node_to_node(mesh), first.node_id, max_nodes).select(F.col("node").alias("node_id"))


def submesh_around(mesh: Mesh, point: tuple[float, float, float], max_nodes: int, along: bool = False) -> Mesh:
    """All elements with a node among those nearest to a point, as a mesh of its own; elements keep their order, nodes theirs,
    and node_mapping leads back."""
    chosen = materialize(nodes_around(mesh, point, max_nodes, along))
    hit = mesh.incidence().join(chosen, "node_id", "left_semi").select("block_id", "elem_id").distinct()
    rows = materialize(dense_ids(mesh.elements.join(hit, ["block_id", "elem_id"]), ["block_id", "elem_id"], "at"))
    low = rows.groupBy("block_id").agg(F.min("at").alias("low"))
    elements = rows.join(F.broadcast(low), "block_id").select("block_id", (F.col("at") - F.col("low")).alias("elem_id"), "nodes")
    ids = dense_ids(rows.select(F.explode("nodes").alias("node_id")).distinct(), ["node_id"], "new_id")
    ids = materialize(ids)
    from .numbering import renumbered

    points = mesh.points.join(ids, "node_id").select(F.col("new_id").alias("node_id"), "x", "y", "z")
    return Mesh(points, renumbered(elements, ids), mesh.blocks, mesh.dim, ids.select(F.col("new_id").alias("node_id"), F.col("node_id").alias("source_id")))
