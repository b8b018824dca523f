"""Projection of functions onto hexahedra's nodes, and the geometry that a lattice keeps for each macro element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elem_types import corners, element_type, linear
from ..mesh import Mesh
from .geometry import _HEX, adjugate, adjugate_and_determinant, corner_columns, determinant, fundamental_form

#: Gauss points on [0, 1] and their weights.
GAUSS = {k: ((np.polynomial.legendre.leggauss(k)[0] + 1) / 2, np.polynomial.legendre.leggauss(k)[1] / 2) for k in (1, 2, 3, 4)}


def hat(k: int, q: tuple[float, float, float]) -> float:
    """The trilinear function of corner k at a point of the unit cube."""
    out = 1.0
    for at, x in zip(_HEX[k], q):
        out *= x if at else 1 - x
    return out


def slope(k: int, q: tuple[float, float, float], axis: int) -> float:
    """Its derivative along an axis."""
    out = 1.0 if _HEX[k][axis] else -1.0
    for a, (at, x) in enumerate(zip(_HEX[k], q)):
        if a != axis:
            out *= x if at else 1 - x
    return out


def quadrature_points(mesh: Mesh, order: int = 2) -> DataFrame:
    """block_id, elem_id, q, x, y, z, weight (the rule's times the Jacobian's determinant) and h0..h7, the corners' functions:
    a row for each of order^3 points of every hexahedron. The rule is a literal of fixed size; nothing is joined."""
    if linear(mesh.elem_type) != "HEX8":
        raise ValueError(f"{mesh.elem_type} is no hexahedron")
    x, w = GAUSS[order]
    rule = []
    for n, (i, j, k) in enumerate((i, j, k) for k in range(order) for j in range(order) for i in range(order)):
        q = (float(x[i]), float(x[j]), float(x[k]))
        slopes = [F.lit(slope(m, q, a)).alias(f"d{m}{a}") for m in range(8) for a in range(3)]
        rule.append(F.struct(F.lit(n).alias("q"), F.lit(float(w[i] * w[j] * w[k])).alias("w"), *[F.lit(hat(m, q)).alias(f"h{m}") for m in range(8)], *slopes))
    rows = corner_columns(mesh, 8).withColumn("r", F.explode(F.array(*rule)))
    total = lambda terms: sum(terms, F.lit(0.0))
    entries = {f"j{c}{a}": total(F.col(f"{c}{m}") * F.col(f"r.d{m}{a}") for m in range(8)) for c in "xyz" for a in range(3)}
    rows = rows.select("block_id", "elem_id", "r", *[total(F.col(f"{c}{m}") * F.col(f"r.h{m}") for m in range(8)).alias(c) for c in "xyz"], *[e.alias(n) for n, e in entries.items()])
    jac = [[F.col(f"j{c}{a}") for a in range(3)] for c in "xyz"]
    return rows.select("block_id", "elem_id", "r.q", "x", "y", "z", (F.col("r.w") * determinant(jac, adjugate(jac))).alias("weight"), *[F.col(f"r.h{m}").alias(f"h{m}") for m in range(8)])


def l2_loads(points: DataFrame, value: Column) -> DataFrame:
    """block_id, elem_id, b0..b7: integrals of a function, given at the quadrature points, against the corners' functions."""
    return points.withColumn("v", value).groupBy("block_id", "elem_id").agg(*[F.sum(F.col("weight") * F.col("v") * F.col(f"h{k}")).alias(f"b{k}") for k in range(8)])


def l2_projection(mesh: Mesh, value: Column, order: int = 2) -> DataFrame:
    """id, value at the nodes of hexahedra: on every element the best trilinear fit of a function of x, y and z (its own 8 x 8
    system, solved in a batch), then the mean over a node's elements, weighted by their shares of the node's lumped mass."""
    points = quadrature_points(mesh, order).withColumn("v", value)
    pairs = [(a, b) for a in range(8) for b in range(a, 8)]
    w = F.col("weight")
    sums = [F.sum(w * F.col("v") * F.col(f"h{k}")).alias(f"b{k}") for k in range(8)] + [F.sum(w * F.col(f"h{a}") * F.col(f"h{b}")).alias(f"m{a}{b}") for a, b in pairs]
    systems = points.groupBy("block_id", "elem_id").agg(*sums)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            m = np.empty((t.num_rows, 8, 8))
            for a, b in pairs:
                m[:, a, b] = m[:, b, a] = t.column(f"m{a}{b}").to_numpy()
            b = np.stack([t.column(f"b{k}").to_numpy() for k in range(8)], 1)
            u = np.linalg.solve(m, b[:, :, None])[:, :, 0]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([t.column("block_id"), t.column("elem_id"), lists(u), lists(m.sum(2))], names=["block_id", "elem_id", "u", "share"])

    local = systems.mapInArrow(solved, "block_id int, elem_id long, u array<double>, share array<double>")
    at = F.array(*[F.get("nodes", F.lit(k)) for k in corners(mesh.elem_type)])
    nodes = mesh.elements.select("block_id", "elem_id", at.alias("at"))
    long = local.join(nodes, ["block_id", "elem_id"]).select(F.explode(F.arrays_zip("at", "u", "share")).alias("x")).select(F.col("x.at").alias("id"), "x.u", "x.share")
    return long.groupBy("id").agg((F.sum(F.col("u") * F.col("share")) / F.sum("share")).alias("value"))


def macro_adjugate(mesh: Mesh) -> DataFrame:
    """block_id, elem_id, a0..a8, det of a hexahedral lattice's macro elements, at their middle: geometry from their corners alone."""
    _needs_lattice(mesh)
    return adjugate_and_determinant(mesh)


def macro_fundamental_form(mesh: Mesh) -> DataFrame:
    _needs_lattice(mesh)
    return fundamental_form(mesh)


def micro_adjugate(macro: DataFrame, level: int) -> DataFrame:
    """The same of a micro element: its edges are a level-th of the macro element's."""
    h = 1.0 / level
    return macro.select("block_id", "elem_id", *[(F.col(f"a{k}") * (h * h)).alias(f"a{k}") for k in range(9)], (F.col("det") * h**3).alias("det"))


def _needs_lattice(mesh: Mesh) -> None:
    t = element_type(mesh.elem_type)
    if not t.semistructured or t.dim != 3:
        raise ValueError(f"{mesh.elem_type} is no hexahedral lattice")
