"""Linear systems over (i, j, value) tables: conjugate gradients as joins and sums, and what distances by diffusion need.

A round is one product of the matrix with the directions (a join on the column and a sum by row), written to the shared
folder with the state it belongs to, and one sum for the new residual; a handful of numbers a round reach the driver. Several
right-hand sides go through the same products. Where unknowns come in groups, as patches of a mesh, the few numbers that are
constant on each are solved for at the driver every round: rounds then grow with a patch's width and not the mesh's. Matrices are kept in ranges of rows, so the sums of a row meet in the task that
reads it, and directions are broadcast while they are of bounded size: then a round shuffles vectors, never the matrix.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.elem_types import linear
from ..mesh import Mesh
from ..storage import materialize
from .geometry import corner_columns

#: Bytes of a round's directions up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Groups of unknowns, at most: their matrix and its inverse are the driver's, 1.3 MB each. And nodes of a patch, at least.
GROUPS, PATCH = 400, 16

Vector = list[Column]


class Solution(NamedTuple):
    values: DataFrame  # id and the right-hand side's columns
    rounds: int
    residuals: dict[str, float]  # of each column, in units of the right-hand side's size


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def product(matrix: DataFrame, vector: DataFrame, columns: tuple[str, ...] = ("value",), small: bool = False) -> DataFrame:
    """id and columns of the matrix (i, j, value) times vectors (id, columns); rows without an entry that counts are left out."""
    side = vector.select(F.col("id").alias("j"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = matrix.join(F.broadcast(side) if small else side, "j")
    return met.groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("value") * F.col(f"__{c}")).alias(c) for c in columns])


def patches(mesh: Mesh) -> DataFrame:
    """id, grp: nodes by the cells of a coarse grid over the mesh, GROUPS at most."""
    ends = mesh.points.agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{c}") for c in "xyz" for k, f in (("a", F.min), ("z", F.max))]).first()
    wide = [c for c in "xyz" if ends[f"a{c}"] is not None and ends[f"z{c}"] > ends[f"a{c}"]]
    m = max([1] + [k for k in range(1, GROUPS + 1) if wide and k ** len(wide) <= min(GROUPS, ends["n"] // PATCH)])
    at = [F.least(F.lit(m - 1), F.floor((F.col(c).cast("double") - ends[f"a{c}"]) * (m / (ends[f"z{c}"] - ends[f"a{c}"]))).cast("int")) * m**k for k, c in enumerate(wide)]
    return mesh.points.select(F.col("node_id").alias("id"), _sum([F.lit(0), *at]).cast("int").alias("grp"))


class _Coarse:
    """The inverse of the groups' matrix, and what it makes of residuals summed by group."""

    def __init__(self, matrix: DataFrame, groups: DataFrame):
        gi, gj = (groups.select(F.col("id").alias(k), F.col("grp").alias(f"g{k}")) for k in "ij")
        rows = matrix.join(gi, "i").join(gj, "j").groupBy("gi", "gj").agg(F.sum("value").alias("value")).collect()
        self.at = {g: k for k, g in enumerate(sorted({r.gi for r in rows}))}
        a = np.zeros((len(self.at), len(self.at)))
        for r in rows:
            a[self.at[r.gi], self.at[r.gj]] = r.value
        self.inverse = np.linalg.inv((a + a.T) / 2)

    def of(self, sums: dict[int, float]) -> tuple[Column, float]:
        """The correction of a row's group (0 without one), and its product with the residual."""
        r = np.array([sums.get(g, 0.0) for g in self.at])
        c = self.inverse @ r
        full = np.zeros(max(self.at, default=0) + 1)
        full[list(self.at)] = c
        told = F.split(F.lit(",".join(map(repr, full.tolist()))), ",").cast("array<double>")
        return F.coalesce(F.get(told, F.col("grp")), F.lit(0.0)), float(r @ c)


def _residuals(df: DataFrame, r: dict[str, Column], coarse: _Coarse | None) -> tuple[float, dict[str, float], dict[str, float], dict[str, Column]]:
    """Rows; of each column: squares of the residual, its product with the preconditioned one, and that one."""
    by = df.groupBy("grp").agg(F.count("*").alias("n"), *[F.sum(f).alias(f"{k}_{c}") for c in r for k, f in (("s", r[c]), ("rr", r[c] * r[c]), ("rz", r[c] * r[c] * F.col("w")))]).collect()
    rr, rz = ({c: float(sum(row[f"{k}_{c}"] or 0.0 for row in by)) for c in r} for k in ("rr", "rz"))
    z = {c: r[c] * F.col("w") for c in r}
    if coarse:
        for c in r:
            near, more = coarse.of({row["grp"]: row[f"s_{c}"] or 0.0 for row in by})
            z[c], rz[c] = z[c] + near, rz[c] + more
    return float(sum(row["n"] for row in by)), rr, rz, z


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, columns: tuple[str, ...] = ("value",), tol: float = 1e-12, max_rounds: int = 10_000, groups: DataFrame | None = None) -> Solution:
    """Solve a symmetric positive definite system, preconditioned by its diagonal and, with groups (id, grp from 0 to GROUPS - 1),
    by the system of what is constant on each group.

    matrix: i, j, value, with every unknown on the diagonal; rhs: id and columns, 0 where an unknown has no row. Ends when
    every residual is at most tol times its right-hand side, by Euclidean norms; raises if that takes more rounds, or if the
    matrix turns out not to be positive definite.
    """
    matrix = materialize(matrix.select("i", "j", "value").repartitionByRange("i"))
    unknown = matrix.where("i = j").groupBy("i").agg(F.sum("value").alias("d"))
    state = unknown.join(rhs.select(F.col("id").alias("i"), *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]), "i", "left")
    coarse = None
    if groups is None:
        state = state.withColumn("grp", F.lit(0))
    else:
        groups = materialize(groups.join(unknown.select(F.col("i").alias("id")), "id"))
        coarse = _Coarse(matrix, groups)
        state = state.join(groups.withColumnRenamed("id", "i"), "i", "left").fillna(-1, ["grp"])
    r = {c: F.coalesce(F.col(f"b_{c}"), F.lit(0.0)) for c in columns}
    state = materialize(state.select(F.col("i").alias("id"), "grp", (1 / F.col("d")).alias("w"), *[F.lit(0.0).alias(f"x_{c}") for c in columns], *[r[c].alias(f"r_{c}") for c in columns]))
    n, bb, rz, z = _residuals(state, {c: F.col(f"r_{c}") for c in columns}, coarse)
    state = state.select("*", *[z[c].alias(f"p_{c}") for c in columns])
    small = n * 8 * (1 + len(columns)) <= BROADCAST_BYTES
    rr, rounds = dict(bb), 0
    open_ = {c for c in columns if bb[c] > 0}
    while open_:
        if rounds >= max_rounds:
            raise RuntimeError(f"no solution within {tol} after {rounds} rounds: " + ", ".join(f"{c} {(rr[c] / bb[c]) ** 0.5:.1e}" for c in sorted(open_)))
        q = product(matrix, state.select("id", *[F.col(f"p_{c}").alias(c) for c in columns]), columns, small)
        q = q.select("id", *[F.col(c).alias(f"q_{c}") for c in columns])
        told = Observation()
        held = state.join(q, "id", "left").fillna(0.0, [f"q_{c}" for c in columns])
        held = materialize(held.observe(told, *[F.sum(F.col(f"p_{c}") * F.col(f"q_{c}")).alias(c) for c in columns]))
        pq = {c: float(told.get[c] or 0.0) for c in columns}
        if any(pq[c] <= 0 for c in open_):
            raise ValueError("the matrix isn't positive definite")
        alpha = {c: rz[c] / pq[c] if c in open_ else 0.0 for c in columns}
        new = {c: F.col(f"r_{c}") - alpha[c] * F.col(f"q_{c}") for c in columns}
        _, rr, now, z = _residuals(held, new, coarse)
        beta = {c: now[c] / rz[c] if c in open_ else 0.0 for c in columns}
        state = held.select("id", "grp", "w", *[(F.col(f"x_{c}") + alpha[c] * F.col(f"p_{c}")).alias(f"x_{c}") for c in columns], *[new[c].alias(f"r_{c}") for c in columns], *[(z[c] + beta[c] * F.col(f"p_{c}")).alias(f"p_{c}") for c in columns])
        rz, rounds = now, rounds + 1
        open_ = {c for c in open_ if rr[c] > tol * tol * bb[c]}
    return Solution(state.select("id", *[F.col(f"x_{c}").alias(c) for c in columns]), rounds, {c: (rr[c] / bb[c]) ** 0.5 if bb[c] else 0.0 for c in columns})


def with_fixed_values(matrix: DataFrame, rhs: DataFrame, fixed: DataFrame, columns: tuple[str, ...] = ("value",)) -> tuple[DataFrame, DataFrame]:
    """The system of the other unknowns when some (fixed: id, columns) are given: their columns go to the right-hand side."""
    given = fixed.select(F.col("id").alias("g"))
    free = matrix.join(given, F.col("i") == F.col("g"), "left_anti")
    moved = product(free, fixed, columns).select("id", *[(-F.col(c)).alias(c) for c in columns])
    kept = rhs.select("id", *columns).join(given, F.col("id") == F.col("g"), "left_anti")
    total = kept.unionByName(moved).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])
    return free.join(given, F.col("j") == F.col("g"), "left_anti"), total


def solve_with_fixed(matrix: DataFrame, rhs: DataFrame, fixed: DataFrame, columns: tuple[str, ...] = ("value",), **how) -> Solution:
    """All unknowns' values, the given ones included."""
    s = conjugate_gradients(*with_fixed_values(matrix, rhs, fixed, columns), columns, **how)
    return s._replace(values=s.values.unionByName(fixed.select("id", *columns)))


def _gradients(mesh: Mesh) -> tuple[DataFrame, int, list[Vector], Column]:
    """A row an element, its corners, the gradients of their hat functions, and its size (area or volume)."""
    kind = linear(mesh.elem_type)
    if kind not in ("TRI3", "TRISHELL3", "TET4"):
        raise ValueError(f"linear triangles and tetrahedra have constant gradients; {mesh.elem_type} hasn't")
    n = 4 if kind == "TET4" else 3
    rows = corner_columns(mesh, n).join(mesh.elements, ["block_id", "elem_id"])
    rows = rows.select("block_id", "elem_id", "nodes", *[F.coalesce(F.col(f"{c}{k}"), F.lit(0.0)).alias(f"{c}{k}") for k in range(n) for c in "xyz"])
    p = [[F.col(f"{c}{k}") for c in "xyz"] for k in range(n)]
    minus = lambda a, b: [x - y for x, y in zip(a, b)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: _sum(x * y for x, y in zip(a, b))
    if n == 4:
        six = dot(cross(minus(p[1], p[0]), minus(p[2], p[0])), minus(p[3], p[0]))
        raw = [cross(minus(p[b], p[a]), minus(p[c], p[a])) for a, b, c in ((1, 3, 2), (0, 2, 3), (0, 3, 1), (0, 1, 2))]
        rows = rows.withColumns({"det": six} | {f"r{k}{c}": v for k in range(4) for c, v in zip("xyz", raw[k])})
        return rows, n, [[F.col(f"r{k}{c}") / F.col("det") for c in "xyz"] for k in range(4)], F.abs("det") / 6
    normal = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    rows = rows.withColumns({f"m{c}": v for c, v in zip("xyz", normal)})
    m = [F.col(f"m{c}") for c in "xyz"]
    rows = rows.withColumn("det", dot(m, m)).withColumns({f"r{k}{c}": v for k in range(3) for c, v in zip("xyz", cross(m, minus(p[(k + 2) % 3], p[(k + 1) % 3])))})
    return rows, n, [[F.col(f"r{k}{c}") / F.col("det") for c in "xyz"] for k in range(3)], F.sqrt("det") / 2


def stiffness(mesh: Mesh) -> DataFrame:
    """i, j, value of the Laplacian's matrix: integrals of the products of hat functions' gradients. Made inside each element's
    row, summed by entry."""
    rows, n, g, size = _gradients(mesh)
    entry = lambda a, b: F.struct(F.get("nodes", F.lit(a)).alias("i"), F.get("nodes", F.lit(b)).alias("j"), (size * _sum(x * y for x, y in zip(g[a], g[b]))).alias("value"))
    entries = rows.select(F.explode(F.array(*[entry(a, b) for a in range(n) for b in range(n)])).alias("e")).select("e.*")
    return entries.groupBy("i", "j").agg(F.sum("value").alias("value"))


def lumped_mass(mesh: Mesh) -> DataFrame:
    """id, value: every node's share of its elements' sizes."""
    rows, n, _, size = _gradients(mesh)
    return rows.select(F.explode(F.slice("nodes", 1, n)).alias("id"), (size / n).alias("value")).groupBy("id").agg(F.sum("value").alias("value"))


def divergence(mesh: Mesh, field: DataFrame) -> DataFrame:
    """id, value: integrals of a nodal vector field's (id, x, y, z) divergence against the hat functions."""
    rows, n, g, size = _gradients(mesh)
    long = rows.select("block_id", "elem_id", size.alias("size"), F.posexplode(F.array(*[F.struct(F.get("nodes", F.lit(k)).alias("id"), *[x.alias(f"g{c}") for c, x in zip("xyz", g[k])]) for k in range(n)])).alias("k", "f"))
    met = long.select("block_id", "elem_id", "size", "f.*").join(field.select("id", "x", "y", "z"), "id")
    flux = _sum(F.col(f"g{c}") * F.coalesce(F.col(c), F.lit(0.0)) for c in "xyz")
    by = met.groupBy("block_id", "elem_id").agg(F.sum(flux * F.col("size") / n).alias("value"))
    nodes = mesh.elements.select("block_id", "elem_id", F.explode(F.slice("nodes", 1, n)).alias("id"))
    return nodes.join(by, ["block_id", "elem_id"]).groupBy("id").agg(F.sum("value").alias("value"))


class Diffused(NamedTuple):
    distance: DataFrame  # id, value
    normals: DataFrame  # id, x, y, z
    rounds: tuple[int, int]  # of the normals and of the distance


def diffused_distance(mesh: Mesh, known: DataFrame, tol: float = 1e-12) -> Diffused:
    """A distance over a whole mesh from nodes where it and its direction are known (id, value, x, y, z).

    The directions are diffused over the mesh as harmonic functions and made unit vectors; the distance is the potential whose
    Laplacian is their divergence and that takes the known values. A direction that vanishes stays zero.
    """
    matrix, axes = materialize(stiffness(mesh)), ("x", "y", "z")
    known = materialize(known.select("id", "value", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in axes]))
    none, groups = known.limit(0), patches(mesh)
    spread = solve_with_fixed(matrix, none, known, axes, tol=tol, groups=groups)
    size = F.sqrt(_sum(F.col(c) * F.col(c) for c in axes))
    normals = materialize(spread.values.withColumn("size", size).select("id", *[F.when(F.col("size") > 0, F.col(c) / F.col("size")).otherwise(0.0).alias(c) for c in axes]))
    load = divergence(mesh, normals).select("id", (-F.col("value")).alias("value"))
    found = solve_with_fixed(matrix, load, known, tol=tol, groups=groups)
    return Diffused(materialize(found.values), normals, (spread.rounds, found.rounds))
