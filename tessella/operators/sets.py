"""Side sets, node sets, selections, boundaries and surfaces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elem_types import EDGES, SIDES, corners, element_type, linear
from ..mesh import Block, Mesh, at_points, by_element
from ..storage import materialize
from . import graph
from .numbering import dense_ids, first_touch, renumbered


def boundary(mesh: Mesh) -> DataFrame:
    """block_id, parent, lfi, nodes of sides that no other element shares: one aggregation by sorted corners."""
    s = graph.sides(mesh)
    one = s.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("block_id", "elem_id", "lfi", "nodes")).alias("s")).where("n = 1")
    return one.select("s.block_id", F.col("s.elem_id").alias("parent"), "s.lfi", "s.nodes")


def skin_sideset(mesh: Mesh) -> DataFrame:
    """parent, lfi, block_id of the boundary; the sides' own nodes aren't shuffled."""
    one = graph.sides(mesh).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("block_id", "elem_id", "lfi")).alias("s")).where("n = 1")
    return one.select(F.col("s.elem_id").alias("parent"), "s.lfi", "s.block_id")


def _held_nodes(mesh: Mesh) -> Mesh:
    """The mesh with the nodes that count for containment: all of an element's, of a lattice its corners, as its linear type."""
    rows = graph.by_type(mesh, lambda elements, t: elements.select("block_id", "elem_id", graph.picked(F.col("nodes"), corners(t)).alias("nodes")) if element_type(t).semistructured else elements.select("block_id", "elem_id", "nodes"))
    kinds = tuple(replace(b, elem_type=linear(b.elem_type)) if element_type(b.elem_type).semistructured else b for b in mesh.blocks)
    return replace(mesh, elements=rows, blocks=kinds)


def uncovered_sides(mesh: Mesh) -> DataFrame:
    """parent, lfi, block_id: sides for which no other element holds all their nodes, whether as a side of its own or not. A
    triangle on a hexahedron's quadrilateral is inner, the quadrilateral isn't; where all sides meet whole, this is `skin_sideset`.

    Sides with equal nodes meet in one aggregation first, so only those that are left look for other elements, through the node
    of theirs that the fewest elements have. Two equal sides of one element don't cover each other, nor do a side's repeated nodes
    count twice. An empty mesh has none.
    """
    mesh = _held_nodes(mesh)
    side = graph.sides(mesh).select(F.struct("block_id", "elem_id").alias("own"), F.expr("shiftleft(1, cast(lfi as int))").alias("bit"), F.array_sort(F.array_distinct("nodes")).alias("held"))
    met = side.groupBy("held").agg(F.min("own").alias("own"), F.max("own").alias("last"), F.bit_or("bit").alias("bits")).where("own = last")
    left = materialize(met.select("own.block_id", "own.elem_id", "bits", "held"))

    at = mesh.elements.select("block_id", "elem_id", F.explode(F.array_distinct("nodes")).alias("node_id"))
    degree = at.groupBy("node_id").agg(F.count("*").alias("n"))
    mine = left.select("block_id", "elem_id", "bits", F.explode("held").alias("node_id")).join(degree, "node_id")
    keyed = mine.groupBy("block_id", "elem_id", "bits").agg(F.min(F.struct("n", "node_id"))["node_id"].alias("node_id"), F.collect_list("node_id").alias("held"))
    other = at.select("node_id", F.col("block_id").alias("other_block"), F.col("elem_id").alias("other"))
    near = keyed.join(other, "node_id").where("other_block <> block_id or other <> elem_id")
    whole = mesh.elements.select(F.col("block_id").alias("other_block"), F.col("elem_id").alias("other"), "nodes")
    covered = near.join(whole, ["other_block", "other"]).where(F.size(F.array_except("held", "nodes")) == 0).select("block_id", "elem_id", "bits").distinct()
    rest = left.join(covered, ["block_id", "elem_id", "bits"], "left_anti")
    lfi = F.expr("explode(filter(sequence(0, 30), k -> (bits & shiftleft(1, k)) <> 0))")
    return rest.select("block_id", F.col("elem_id").alias("parent"), lfi.alias("lfi")).select("parent", F.col("lfi").cast("short").alias("lfi"), "block_id")


def sideset_sides(mesh: Mesh, sideset: DataFrame) -> DataFrame:
    """block_id, parent, lfi, nodes of a side set's sides."""
    s = graph.sides(mesh).select("block_id", F.col("elem_id").alias("parent"), "lfi", "nodes")
    return s.join(sideset.select("block_id", "parent", "lfi").distinct(), ["block_id", "parent", "lfi"])


def nodeset(mesh: Mesh, *sidesets: DataFrame) -> DataFrame:
    """node_id: distinct nodes of the side sets' sides."""
    out = None
    for s in sidesets:
        out = s if out is None else out.unionByName(s)
    return sideset_sides(mesh, out).select(F.explode("nodes").alias("node_id")).distinct()


def side_centroids(mesh: Mesh, corners_only: bool = False) -> DataFrame:
    """block_id, elem_id, lfi, x, y, z: means over all nodes of each side (or its corners)."""
    s = graph.sides(mesh, corners_only).select("block_id", "elem_id", "lfi", F.explode("nodes").alias("node_id"))
    return by_element(at_points(s, mesh.points).drop("node_id"), "lfi").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"])


def centroids(mesh: Mesh) -> DataFrame:
    """block_id, elem_id, x, y, z: means over all nodes of each element."""
    long = mesh.elements.select("block_id", "elem_id", F.explode("nodes").alias("node_id"))
    return by_element(at_points(long, mesh.points).drop("node_id")).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"])


def select_elements(mesh: Mesh, predicate: Column, blocks: list[str] | None = None) -> DataFrame:
    """block_id, elem_id of elements whose centroid (x, y, z) satisfies a predicate."""
    mine = replace(mesh, elements=mesh.elements.where(F.col("block_id").isin(mesh.ids_of(blocks))))
    return centroids(mine).where(predicate).select("block_id", "elem_id")


def sideset_where(mesh: Mesh, predicate: Column, blocks: list[str] | None = None) -> DataFrame:
    """Sides whose centroid satisfies a predicate over x, y and z; inner sides count once for each element.

    A pandas_udf over the three columns serves as a predicate on batches.
    """
    mine = replace(mesh, elements=mesh.elements.where(F.col("block_id").isin(mesh.ids_of(blocks))))
    return side_centroids(mine).where(predicate).select(F.col("elem_id").alias("parent"), "lfi", "block_id")


def sideset_on_plane(mesh: Mesh, normal: tuple[float, float, float], distance: float, tol: float = 1e-8) -> DataFrame:
    d = sum((F.coalesce(F.col(c), F.lit(0.0)) * float(n) for c, n in zip("xyz", normal)), F.lit(0.0)) - float(distance)
    return sideset_where(mesh, F.abs(d) < tol)


def sides_by_parent(sideset: DataFrame) -> DataFrame:
    return sideset.groupBy("block_id", "parent").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("lfi")).alias("sides"))


def surface_mesh(mesh: Mesh, sideset: DataFrame, name: str = "surface") -> Mesh:
    """The side set as a mesh of its own; nodes numbered by first touch, node_mapping leads back."""
    rows = dense_ids(sideset_sides(mesh, sideset), ["block_id", "parent", "lfi"], "elem_id")
    rows = rows.select(F.lit(0).alias("block_id"), "elem_id", "nodes")
    return _compacted(mesh, rows, (Block(0, name, side_type_of(mesh)),))


def _compacted(mesh: Mesh, rows: DataFrame, blocks: tuple[Block, ...]) -> Mesh:
    ids = materialize(first_touch(rows.select("block_id", "elem_id", F.posexplode("nodes").alias("lnode", "node_id"))))
    points = mesh.points.join(ids, "node_id").select(F.col("new_id").alias("node_id"), "x", "y", "z")
    return Mesh(points, renumbered(rows, ids), blocks, mesh.dim, ids.select(F.col("new_id").alias("node_id"), F.col("node_id").alias("source_id")))


def skin(mesh: Mesh) -> Mesh:
    return surface_mesh(mesh, skin_sideset(mesh))


def renumber_nodes(mesh: Mesh, mapping: DataFrame | None = None) -> Mesh:
    """Nodes by first touch, or by a given permutation (node_id, new_id)."""
    ids = mapping if mapping is not None else materialize(first_touch(mesh.incidence()))
    points = mesh.points.join(ids, "node_id").select(F.col("new_id").alias("node_id"), "x", "y", "z")
    return replace(mesh, points=points, elements=renumbered(mesh.elements, ids))


def select_submesh(mesh: Mesh, chosen: DataFrame) -> Mesh:
    """chosen: pos, block_id, elem_id. Elements in the given order, repeats kept; nodes by first touch, mapped back."""
    rows = chosen.join(mesh.elements, ["block_id", "elem_id"])
    rows = dense_ids(rows, ["block_id", "pos"], "at")
    low = rows.groupBy("block_id").agg(F.min("at").alias("low"))
    rows = rows.join(F.broadcast(low), "block_id").select("block_id", (F.col("at") - F.col("low")).alias("elem_id"), "nodes")
    return _compacted(mesh, rows, mesh.blocks)


def split_block(mesh: Mesh, chosen: DataFrame, name: str) -> Mesh:
    """chosen: pos, elem_id of a single-block mesh. Block 0 takes them in order (repeats once), block 1 what is left."""
    first = chosen.groupBy("elem_id").agg(F.min("pos").alias("pos"))
    taken = dense_ids(first.join(mesh.elements, "elem_id"), ["pos"], "new").select(F.lit(0).alias("block_id"), F.col("new").alias("elem_id"), "nodes")
    rest = dense_ids(mesh.elements.join(first, "elem_id", "left_anti"), ["elem_id"], "new").select(F.lit(1).alias("block_id"), F.col("new").alias("elem_id"), "nodes")
    if len(mesh.blocks) != 1:
        raise ValueError("a mesh of one block is split")
    old = mesh.blocks[0]
    return replace(mesh, elements=taken.unionByName(rest), blocks=(Block(0, name, old.elem_type), Block(1, old.name, old.elem_type)))


def split_boundary_layer(mesh: Mesh) -> Mesh:
    layer = skin_sideset(mesh).select(F.col("parent").alias("elem_id")).distinct()
    return split_block(mesh, layer.select(F.col("elem_id").alias("pos"), "elem_id"), "boundary_layer")


def reorder_by_tags(elements: DataFrame, tags: DataFrame) -> DataFrame:
    """old_id, new_id: elements stably sorted by tag (tags: elem_id, tag)."""
    return dense_ids(tags.join(elements.select("elem_id"), "elem_id", "left_semi"), ["tag", "elem_id"], "new_id").select(F.col("elem_id").alias("old_id"), "new_id")


def surface_is_closed(mesh: Mesh) -> DataFrame:
    """is_closed: every edge of every surface element is another one's too."""
    kinds = {linear(b.elem_type) for b in mesh.blocks}
    if not kinds <= {"TRI3", "QUAD4", "TRISHELL3", "QUADSHELL4"}:
        return mesh.spark.createDataFrame([(False,)], "is_closed boolean")

    def rows(elements: DataFrame, t: str) -> DataFrame:
        at = corners(t)
        return graph.patterned(elements, tuple((at[a], at[b]) for a, b in SIDES[linear(t)])).select(F.array_sort("nodes").alias("key"))

    counts = graph.by_type(mesh, rows).groupBy("key").agg(F.count("*").alias("n"))
    return counts.agg((F.coalesce(F.min("n"), F.lit(0)) >= 2).alias("is_closed"))


def face_normals(mesh: Mesh) -> DataFrame:
    """block_id, elem_id, nx, ny, nz: unit normals from the first three corners of surface elements."""
    long = mesh.elements.select("block_id", "elem_id", F.posexplode(F.slice("nodes", 1, 3)).alias("k", "node_id")).join(mesh.points, "node_id")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c).cast("double"))).alias(f"{c}{k}")
    p = long.groupBy("block_id", "elem_id").agg(*[at(k, c) for k in range(3) for c in "xyz"])
    u = [F.coalesce(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0)) for c in "xyz"]
    v = [F.coalesce(F.col(f"{c}2") - F.col(f"{c}0"), F.lit(0.0)) for c in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return p.select("block_id", "elem_id", *[(x / size).alias(f"n{c}") for x, c in zip(n, "xyz")])


def sharp_edges(mesh: Mesh, threshold: float = 0.15) -> DataFrame:
    """e0 < e1: edges whose first two faces (by element) have normals with a dot product of at most the threshold."""
    from pyspark.sql import Window as W

    t = linear(mesh.elem_type)
    pairs = graph.patterned(mesh.elements, EDGES[t]).select("elem_id", F.array_min("nodes").alias("e0"), F.array_max("nodes").alias("e1"))
    w = W.partitionBy("e0", "e1").orderBy("elem_id")
    faces = pairs.join(face_normals(mesh), "elem_id").withColumn("k", F.row_number().over(w)).where("k <= 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    dot = sum((at(1, c) * at(2, c) for c in ("nx", "ny", "nz")), F.lit(0.0))
    return faces.groupBy("e0", "e1").agg(F.count("*").alias("n"), dot.alias("dot")).where(F.col("n") == 2).where(F.col("dot") <= threshold).select("e0", "e1")


def sharp_corners(sharp: DataFrame) -> DataFrame:
    """node_id of nodes on three or more sharp edges."""
    ends = sharp.select(F.explode(F.array("e0", "e1")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("n")).where("n >= 3").select("node_id")


def edges_without_corners(sharp: DataFrame, corner_nodes: DataFrame) -> DataFrame:
    c = corner_nodes.select(F.col("node_id").alias("c"))
    return sharp.join(c, F.col("e0") == F.col("c"), "left_anti").join(c, F.col("e1") == F.col("c"), "left_anti")


def disconnected_faces(mesh: Mesh, sharp: DataFrame) -> DataFrame:
    """elem_id of surface elements without a node on a sharp edge."""
    touched = sharp.select(F.explode(F.array("e0", "e1")).alias("node_id")).distinct()
    hit = mesh.incidence().join(touched, "node_id", "left_semi").select("elem_id").distinct()
    return mesh.elements.select("elem_id").join(hit, "elem_id", "left_anti")


def propagate(side_links: DataFrame, seeds: DataFrame, max_rounds: int | None = None, cut_every: int = 8) -> DataFrame:
    """side: everything reached from the seeds over accepted links (a, b), the seeds included; breadth first."""
    links = materialize(side_links.select("a", "b").distinct())
    seen = materialize(seeds.select(F.col("side")).distinct())
    front, k = seen, 0
    while True:
        nxt = front.withColumnRenamed("side", "a").join(links, "a").select(F.col("b").alias("side")).distinct().join(seen, "side", "left_anti")
        nxt = materialize(nxt)
        if not nxt.limit(1).count():
            break
        if max_rounds is not None and k >= max_rounds:
            raise RuntimeError(f"more can be reached after {max_rounds} rounds")
        seen, front, k = seen.unionByName(nxt), nxt, k + 1
        if k % cut_every == 0:
            seen = materialize(seen)
    return seen


def side_links(sides: DataFrame, least: int = 2) -> DataFrame:
    """a, b: sides (side, nodes) that share at least so many nodes."""
    long = sides.select("side", F.explode("nodes").alias("node_id"))
    other = long.select(F.col("side").alias("b"), "node_id")
    return long.withColumnRenamed("side", "a").join(other, "node_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b")


def side_type_of(mesh: Mesh) -> str:
    """The one type of all sides' surfaces; an error for blocks whose sides differ."""
    kinds = {element_type(element_type(b.elem_type).side_type).shell_type or element_type(b.elem_type).side_type for b in mesh.blocks}
    if len(kinds) != 1:
        raise ValueError(f"sides of several types don't make one block: {sorted(kinds)}")
    return kinds.pop()


def sideset_from_seed(mesh: Mesh, point: tuple[float, float, float], threshold: float) -> DataFrame:
    """parent, lfi, block_id: the boundary side nearest to a point, and all reached from it over neighbours whose unit
    normals have an absolute cosine above the threshold."""
    from .regions import linked_groups, smooth_links

    skin_ = materialize(dense_ids(boundary(mesh), ["block_id", "parent", "lfi"], "side"))
    kind = side_type_of(mesh)
    shell = Mesh(mesh.points, skin_.select(F.lit(0).alias("block_id"), F.col("side").alias("elem_id"), "nodes"), (Block(0, "s", kind),), mesh.dim)
    long = shell.elements.select(F.col("elem_id").alias("side"), F.explode(F.slice("nodes", 1, len(corners(kind)))).alias("node_id")).join(mesh.points, "node_id")
    mid = long.groupBy("side").agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0)).cast("double")).alias(c) for c in "xyz"])
    d = sum(((F.col(c) - float(p)) * (F.col(c) - float(p)) for c, p in zip("xyz", point)), F.lit(0.0))
    seed = mid.select("side", d.alias("d")).orderBy("d", "side").limit(1).select("side")
    groups = materialize(linked_groups(smooth_links(shell, threshold).select(F.col("e1").alias("a"), F.col("e2").alias("b"))).members)
    reached = groups.join(groups.join(seed, F.col("node") == F.col("side")).select("group"), "group", "left_semi").select(F.col("node").alias("side"))
    return reached.unionByName(seed).distinct().join(skin_, "side").select("parent", "lfi", "block_id")


def nearest_elements(mesh: Mesh, point: tuple[float, float, float], n: int) -> DataFrame:
    """block_id, elem_id, d2 of the n elements nearest by centroid: a bounded top-k."""
    d = sum(((F.col(c) - float(p)) * (F.col(c) - float(p)) for c, p in zip("xyz", point)), F.lit(0.0))
    return centroids(mesh).select("block_id", "elem_id", d.alias("d2")).orderBy("d2", "block_id", "elem_id").limit(n)
