"""Conversion, promotion, refinement, extrusion and concatenation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elem_types import EDGES, element_type, hex_corner, lattice_index, linear
from ..mesh import Mesh, unfolded
from ..storage import materialize
from . import graph
from .numbering import dense_ids

# How an element falls into smaller ones, by local nodes.
HEX8_TO_TET4 = ((0, 1, 3, 7), (0, 1, 7, 5), (0, 4, 5, 7), (1, 2, 3, 6), (1, 3, 7, 6), (1, 5, 6, 7))
TET15_TO_HEX8 = ((0, 4, 13, 6, 7, 10, 14, 12), (4, 1, 5, 13, 10, 8, 11, 14), (13, 5, 2, 6, 14, 11, 9, 12), (7, 10, 14, 12, 3, 8, 11, 9))
WEDGE6_TO_TET4 = ((0, 1, 2, 3), (1, 4, 5, 3), (2, 1, 5, 3))
QUAD4_TO_TRI3 = ((0, 1, 2), (0, 2, 3))
TET10_TO_TET4 = graph.MACRO_TET4
TRI6_TO_TRI3 = ((0, 3, 5), (3, 1, 4), (5, 4, 2), (3, 4, 5))


def micro_cells(elem_type: str) -> tuple[str, tuple[tuple[int, ...], ...]]:
    """The linear cells of a semistructured element, x fastest."""
    t = element_type(elem_type)
    n = t.level
    at = lambda x, y, z: lattice_index(n, x, y, z)
    if t.dim == 3:
        cell = lambda x, y, z: (at(x, y, z), at(x + 1, y, z), at(x + 1, y + 1, z), at(x, y + 1, z), at(x, y, z + 1), at(x + 1, y, z + 1), at(x + 1, y + 1, z + 1), at(x, y + 1, z + 1))
        return "HEX8", tuple(cell(x, y, z) for z in range(n) for y in range(n) for x in range(n))
    return linear(elem_type), tuple((at(x, y, 0), at(x + 1, y, 0), at(x + 1, y + 1, 0), at(x, y + 1, 0)) for y in range(n) for x in range(n))


def split(mesh: Mesh, pattern: tuple[tuple[int, ...], ...], elem_type: str) -> Mesh:
    """Each element into len(pattern) new ones, numbered elem_id * len(pattern) + sub."""
    rows = graph.patterned(mesh.elements, pattern).select("block_id", (F.col("elem_id") * len(pattern) + F.col("sub")).alias("elem_id"), "nodes")
    return replace(mesh, elements=rows, blocks=tuple(replace(b, elem_type=elem_type) for b in mesh.blocks))


def convert_to(mesh: Mesh, elem_type: str) -> Mesh:
    have = mesh.elem_type
    if have == elem_type:
        return mesh
    patterns = {("HEX8", "TET4"): HEX8_TO_TET4, ("TET15", "HEX8"): TET15_TO_HEX8, ("WEDGE6", "TET4"): WEDGE6_TO_TET4, ("QUAD4", "TRI3"): QUAD4_TO_TRI3}
    if (have, elem_type) in patterns:
        return split(mesh, patterns[have, elem_type], elem_type)
    lattice_order = tuple(hex_corner(1, k) for k in range(8))
    if (have, elem_type) == ("PROTEUS_HEX8", "HEX8"):
        return replace(mesh, elements=mesh.elements.withColumn("nodes", graph.picked(F.col("nodes"), lattice_order))).with_type("HEX8")
    if (have, elem_type) == ("HEX8", "PROTEUS_HEX8"):
        back = tuple(lattice_order.index(k) for k in range(8))
        return replace(mesh, elements=mesh.elements.withColumn("nodes", graph.picked(F.col("nodes"), back))).with_type("PROTEUS_HEX8")
    if element_type(have).semistructured and elem_type == micro_cells(have)[0]:
        return split(mesh, micro_cells(have)[1], elem_type)
    raise ValueError(f"no conversion from {have} to {elem_type}")


def edge_numbers(mesh: Mesh, first: int) -> DataFrame:
    """i < j, node: edges numbered from `first` in the order of (i, j)."""
    return dense_ids(graph.edges(mesh), ["i", "j"], "node", first)


def _edge_nodes(mesh: Mesh, numbers: DataFrame) -> DataFrame:
    """block_id, elem_id, lnode, node_id of corners and mid-edge nodes."""
    t = linear(mesh.elem_type)
    n = element_type(t).n_nodes
    pairs = graph.patterned(mesh.elements, EDGES[t]).select("block_id", "elem_id", (F.col("sub") + n).alias("lnode"), F.array_min("nodes").alias("i"), F.array_max("nodes").alias("j"))
    return mesh.incidence().unionByName(unfolded(pairs).join(numbers, ["i", "j"]).select("block_id", "elem_id", "lnode", F.col("node").alias("node_id")))


def midpoints(points: DataFrame, numbers: DataFrame) -> DataFrame:
    a = points.select(F.col("node_id").alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = points.select(F.col("node_id").alias("j"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return numbers.join(a, "i").join(b, "j").select(F.col("node").alias("node_id"), *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).cast("float").alias(c) for c in "xyz"])


def _second_order(mesh: Mesh, elem_type: str) -> Mesh:
    from .numbering import regathered

    numbers = edge_numbers(mesh, mesh.n_nodes())
    return Mesh(mesh.points.unionByName(midpoints(mesh.points, numbers)), regathered(_edge_nodes(mesh, numbers)), (replace(mesh.blocks[0], elem_type=elem_type),), mesh.dim)


def _tet15(mesh: Mesh) -> Mesh:
    """Nodes, then edges by (i, j), faces by their first element and side, then centres."""
    from .numbering import regathered

    n = mesh.n_nodes()
    numbers = materialize(edge_numbers(mesh, n))
    n_edges = numbers.count()
    s = graph.sides(mesh, corners_only=True)
    faces = s.groupBy("key").agg(F.min(F.struct("elem_id", "lfi", "nodes")).alias("first"))
    faces = materialize(dense_ids(faces, ["first.elem_id", "first.lfi"], "node", n + n_edges))
    n_faces = faces.count()
    edge_rows = _edge_nodes(mesh, numbers)
    face_rows = unfolded(s.select("block_id", "elem_id", (F.col("lfi").cast("int") + 10).alias("lnode"), "key")).join(faces.select("key", F.col("node").alias("node_id")), "key").drop("key")
    centre = mesh.elements.select("block_id", "elem_id", F.lit(14).alias("lnode"), (F.col("elem_id") + n + n_edges + n_faces).alias("node_id"))
    rows = regathered(edge_rows.unionByName(face_rows).unionByName(centre))

    def means(owner: DataFrame) -> DataFrame:
        """owner: node, v (a corner)."""
        joined = unfolded(owner).join(mesh.points, F.col("v") == mesh.points.node_id)
        return joined.groupBy("node").agg(*[F.avg(F.col(c).cast("double")).cast("float").alias(c) for c in "xyz"]).withColumnRenamed("node", "node_id")

    face_points = means(faces.select("node", F.explode("key").alias("v")))
    centre_points = means(mesh.elements.select((F.col("elem_id") + n + n_edges + n_faces).alias("node"), F.explode("nodes").alias("v")))
    points = mesh.points.unionByName(midpoints(mesh.points, numbers)).unionByName(face_points).unionByName(centre_points)
    return Mesh(points, rows, (replace(mesh.blocks[0], elem_type="TET15"),), mesh.dim)


def promote_to(mesh: Mesh, elem_type: str) -> Mesh:
    have = mesh.elem_type
    if (have, elem_type) in (("TET4", "TET10"), ("TRI3", "TRI6")):
        return _second_order(mesh, elem_type)
    if (have, elem_type) == ("TET4", "TET15"):
        return _tet15(mesh)
    raise ValueError(f"no promotion from {have} to {elem_type}")


def refine(mesh: Mesh, levels: int = 1) -> Mesh:
    """TET4 into 8, TRI3 into 4, each level; HEX8 through a lattice of 2^levels."""
    t = mesh.elem_type
    if t == "HEX8":
        from .lattice import to_semistructured

        m = to_semistructured(mesh, 2**levels)
        return split(m, micro_cells(m.elem_type)[1], "HEX8")
    fine = {"TET4": ("TET10", TET10_TO_TET4), "TRI3": ("TRI6", TRI6_TO_TRI3)}
    if t not in fine:
        raise ValueError(f"no refinement of {t}")
    for _ in range(levels):
        m = _second_order(mesh, fine[t][0])
        mesh = split(replace(m, elements=materialize(m.elements), points=materialize(m.points)), fine[t][1], t)
    return mesh


def extrude(mesh: Mesh, height: float, layers: int) -> Mesh:
    """Layers along node pseudo-normals: QUAD4 to HEX8, TRI3 to WEDGE6; node id = layer * n + id."""
    from .sets import face_normals

    t = linear(mesh.elem_type)
    out = {"QUAD4": "HEX8", "QUADSHELL4": "HEX8", "TRI3": "WEDGE6", "TRISHELL3": "WEDGE6"}
    if t not in out:
        raise ValueError(f"no extrusion of {t}")
    n, ne = mesh.n_nodes(), mesh.n_elements()
    sums = mesh.incidence().join(face_normals(mesh), ["block_id", "elem_id"]).groupBy("node_id").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"])
    size = F.sqrt(sum((F.col(f"s{c}") * F.col(f"s{c}") for c in "xyz"), F.lit(0.0)))
    base = mesh.points.join(sums, "node_id", "left")
    layer = F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer")
    at = [(F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(F.col(f"s{c}") / size, F.lit(0.0)) * (F.col("layer") * (height / layers))).cast("float").alias(c) for c in "xyz"]
    points = base.select("*", layer).select((F.col("layer") * n + F.col("node_id")).alias("node_id"), *at)
    up = lambda k: F.transform("nodes", lambda v: v + (F.col("layer") + k) * n)
    rows = mesh.elements.select("block_id", "elem_id", "nodes", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    rows = rows.select("block_id", (F.col("layer") * ne + F.col("elem_id")).alias("elem_id"), F.concat(up(0), up(1)).alias("nodes"))
    return Mesh(points, rows, tuple(replace(b, elem_type=out[t]) for b in mesh.blocks), 3)


def concatenate(a: Mesh, b: Mesh) -> Mesh:
    """b's points and elements behind a's; nothing is merged."""
    if a.elem_type != b.elem_type:
        raise ValueError("only meshes of one type can be put together")
    n, ne = a.n_nodes(), a.n_elements()
    points = b.points.withColumn("node_id", F.col("node_id") + n)
    rows = b.elements.select(F.lit(a.blocks[0].block_id).alias("block_id"), (F.col("elem_id") + ne).alias("elem_id"), F.transform("nodes", lambda v: v + n).alias("nodes"))
    return replace(a, points=a.points.unionByName(points), elements=a.elements.unionByName(rows))


def side_surface_quads(mesh: Mesh, sideset: DataFrame) -> DataFrame:
    """parent, lfi, sub, nodes: each lattice side of a semistructured side set as level * level quadrilaterals."""
    from .sets import sideset_sides

    t = element_type(mesh.elem_type)
    n = t.level
    at = lambda x, y: lattice_index(n, x, y)
    quads = tuple((at(x, y), at(x + 1, y), at(x + 1, y + 1), at(x, y + 1)) for y in range(n) for x in range(n))
    rows = F.array(*[graph.picked(F.col("nodes"), q) for q in quads])
    return sideset_sides(mesh, sideset).select("parent", "lfi", F.posexplode(rows).alias("sub", "nodes"))


