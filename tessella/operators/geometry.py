"""Per-element geometry: barycentres, Jacobians, adjugates and first fundamental forms, as expressions on corner columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.elem_types import corners, element_type
from ..mesh import Mesh, at_points, by_element

_HEX = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
Matrix = list[list[Column]]


def barycenters(mesh: Mesh) -> DataFrame:
    """block_id, elem_id, x, y, z as floats; z is null in the plane."""
    from .sets import centroids

    return centroids(mesh).select("block_id", "elem_id", *[F.col(c).cast("float").alias(c) for c in "xyz"])


def located(mesh: Mesh) -> Mesh:
    """The mesh with each node of its rows replaced by where it is (x, y, z): what its elements are split into afterwards meets
    no points any more."""
    n = element_type(mesh.elem_type).n_nodes
    long = at_points(mesh.elements.select("block_id", "elem_id", F.posexplode("nodes").alias("k", "node_id")), mesh.points).drop("node_id")
    rows = by_element(long).agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(n) for c in "xyz"])
    nodes = F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(n)])
    rows, first = rows.select("block_id", "elem_id", nodes.alias("nodes")), mesh.first_rows()
    told = None if first is None else (rows, rows.join(first.drop("nodes", "levels"), ["block_id", "elem_id"]))
    return replace(mesh, elements=rows, told=told)


def corner_columns(mesh: Mesh, n: int | None = None) -> DataFrame:
    """block_id, elem_id and x0, y0, z0, x1, ...: corner coordinates side by side, by one aggregation; of a `located` mesh by none."""
    at = corners(mesh.elem_type)[:n]
    if isinstance(mesh.elements.schema["nodes"].dataType.elementType, T.StructType):
        return mesh.elements.select("block_id", "elem_id", *[F.get("nodes", F.lit(k))[c].cast("double").alias(f"{c}{i}") for i, k in enumerate(at) for c in "xyz"])
    picked = F.array(*[F.get("nodes", F.lit(k)) for k in at])
    long = at_points(mesh.elements.select("block_id", "elem_id", F.posexplode(picked).alias("k", "node_id")), mesh.points).drop("node_id")
    cols = [F.max(F.when(F.col("k") == k, F.col(c).cast("double"))).alias(f"{c}{k}") for k in range(len(at)) for c in "xyz"]
    return by_element(long).agg(*cols)


def tet4_jacobian() -> Matrix:
    """Columns p1 - p0, p2 - p0, p3 - p0."""
    return [[F.col(f"{c}{k}") - F.col(f"{c}0") for k in (1, 2, 3)] for c in "xyz"]


def hex8_jacobian(q: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> Matrix:
    """Derivatives of the trilinear map at q."""

    def slope(corner: tuple[int, int, int], axis: int) -> float:
        w = 1.0
        for d in range(3):
            w *= (1.0 if corner[d] else -1.0) if d == axis else q[d] if corner[d] else 1 - q[d]
        return w

    return [[sum((F.col(f"{c}{k}") * slope(p, a) for k, p in enumerate(_HEX)), F.lit(0.0)) for a in range(3)] for c in "xyz"]


def adjugate(j: Matrix) -> Matrix:
    """Row-major adjugate: minors of the transpose."""
    minor = lambda r, c: j[(r + 1) % 3][(c + 1) % 3] * j[(r + 2) % 3][(c + 2) % 3] - j[(r + 1) % 3][(c + 2) % 3] * j[(r + 2) % 3][(c + 1) % 3]
    return [[minor(c, r) for c in range(3)] for r in range(3)]


def determinant(j: Matrix, adj: Matrix) -> Column:
    return j[0][0] * adj[0][0] + j[0][1] * adj[1][0] + j[0][2] * adj[2][0]


def _staged(mesh: Mesh, q: tuple[float, float, float]) -> tuple[DataFrame, Matrix, bool]:
    """The Jacobian's entries as columns of their own, so later expressions don't repeat them."""
    tet = element_type(mesh.elem_type).n_sides == 4
    base = corner_columns(mesh)
    j = tet4_jacobian() if tet else hex8_jacobian(q)
    named = base.select("block_id", "elem_id", *[j[r][c].alias(f"j{r}{c}") for r in range(3) for c in range(3)])
    return named, [[F.col(f"j{r}{c}") for c in range(3)] for r in range(3)], tet


def adjugate_and_determinant(mesh: Mesh, q: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> DataFrame:
    """block_id, elem_id, a0..a8, det."""
    named, j, _ = _staged(mesh, q)
    adj = adjugate(j)
    return named.select("block_id", "elem_id", *[adj[r][c].alias(f"a{3 * r + c}") for r in range(3) for c in range(3)], determinant(j, adj).alias("det"))


def fundamental_form(mesh: Mesh, q: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> DataFrame:
    """block_id, elem_id, f0..f5, det: the symmetric det * J^-1 J^-T, for tetrahedra over six (their volume)."""
    full = adjugate_and_determinant(mesh, q)
    tet = element_type(mesh.elem_type).n_sides == 4
    a = [[F.col(f"a{3 * r + c}") for c in range(3)] for r in range(3)]
    scale = F.col("det") * (6.0 if tet else 1.0)
    dot = lambda r, s: a[r][0] * a[s][0] + a[r][1] * a[s][1] + a[r][2] * a[s][2]
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return full.select("block_id", "elem_id", *[(dot(r, s) / scale).alias(f"f{k}") for k, (r, s) in enumerate(pairs)], (F.col("det") / (6.0 if tet else 1.0)).alias("det"))


def volumes(mesh: Mesh) -> DataFrame:
    """Signed volume of tetrahedra; of hexahedra, the Jacobian at the centre."""
    tet = element_type(mesh.elem_type).n_sides == 4
    return adjugate_and_determinant(mesh).select("block_id", "elem_id", (F.col("det") / (6.0 if tet else 1.0)).alias("volume"))


def axis_aligned_diagonal(mesh: Mesh) -> DataFrame:
    """block_id, elem_id, dx, dy, dz of axis-aligned hexahedra."""
    c = corner_columns(mesh)
    return c.select("block_id", "elem_id", (F.col("x6") - F.col("x0")).alias("dx"), (F.col("y6") - F.col("y0")).alias("dy"), (F.col("z6") - F.col("z0")).alias("dz"))


def node_normals(mesh: Mesh) -> DataFrame:
    """node_id, nx, ny, nz: normalised sums of unit face normals."""
    from .sets import face_normals

    s = mesh.incidence().join(face_normals(mesh), ["block_id", "elem_id"]).groupBy("node_id").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"])
    size = F.sqrt(sum((F.col(f"s{c}") * F.col(f"s{c}") for c in "xyz"), F.lit(0.0)))
    return s.select("node_id", *[(F.col(f"s{c}") / size).alias(f"n{c}") for c in "xyz"])


def signed_distance(points: DataFrame, surface: DataFrame, reach: float | None = None) -> DataFrame:
    """node_id, distance from points to the nearest of some surface points (node_id, x, y, z), without a sign: points have no
    side (`distance.distance_to_surface` has one). Null beyond `reach`, if one is given, and without a finite surface point."""
    from .distance import distance_to_points

    out = distance_to_points(points, surface)
    return out if reach is None else out.withColumn("distance", F.when(F.col("distance") <= reach, F.col("distance")))
