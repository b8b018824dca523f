"""Registered queries of semistructured meshes: rows by integer lattice coordinates, which SQL has in closed form.

The carriers are the cube and the square whose size follows `part`; a node is compared by where it is, (i, j, k) in steps
of a cell's edge over the level, so numbering, connectivity and points have to fit together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mesh import Mesh
from ..operators import convert, geometry, graph, lattice, sets, transfer
from ..storage import materialize
from .registry import CELLS, DIMS, FLAT, cells, cube, query, square

# Fixed values, spelt out here so that SQL doesn't share the implementation's tables: a hexahedron's corners and sides.
CORNERS = "[[0,0,0],[1,0,0],[1,1,0],[0,1,0],[0,0,1],[1,0,1],[1,1,1],[0,1,1]]"
SIDES = "[[0,1,5,4],[1,2,6,5],[2,3,7,6],[3,0,4,7],[3,2,1,0],[4,5,6,7]]"
#: A field without any regularity: what interpolation gets wrong shows.
FIELD = "cast((7 * {0} + 11 * {1} + 13 * {2}) % 17 as double)"


def _grid(level: int, names: str = "ijk") -> str:
    """All lattice nodes of the cube (or square)."""
    return "(select " + ", ".join(names) + " from dims" + "".join(f", lateral (select unnest(range(n * {level} + 1)) as {c}) as r{c}" for c in names) + ")"


def _at(mesh: Mesh, per_side: int, names: str = "ijk"):
    """node_id and its lattice coordinates."""
    return mesh.points.select("node_id", *[F.round(F.col(c).cast("double") * per_side).cast("long").alias(a) for a, c in zip(names, "xyz")])


def _placed(mesh: Mesh, per_side: int, names: str = "ijk"):
    return mesh.incidence().join(_at(mesh, per_side, names), "node_id").select("elem_id", F.col("lnode").cast("long").alias("lnode"), *names)


def _valued(mesh: Mesh, per_side: int, names: str = "ijk"):
    at = _at(mesh, per_side, names)
    third = F.col("k") if "k" in names else F.lit(0)
    return at.select(F.col("node_id").alias("id"), F.lit(0).alias("comp"), ((7 * F.col("i") + 11 * F.col("j") + 13 * third) % 17).cast("double").alias("value"))


def _told(field, mesh: Mesh, per_side: int, names: str = "ijk"):
    return field.join(_at(mesh, per_side, names), F.col("id") == F.col("node_id")).select(*names, F.round("value", 9).alias("value"))


@query("lattice_points", f"with {DIMS} select i, j, k from {_grid(3)}")
def _(spark, d):
    n = cells(spark, d)
    return _at(lattice.to_semistructured(cube(spark, d), 3), 3 * n).select("i", "j", "k")


@query("lattice_elements", f"with {CELLS} select e as elem_id, l as lnode, cx * 2 + l % 3 as i, cy * 2 + (l // 3) % 3 as j, cz * 2 + l // 9 as k from (select *, unnest(range(27)) as l from cells)")
def _(spark, d):
    return _placed(lattice.to_semistructured(cube(spark, d), 2), 2 * cells(spark, d))


@query("lattice_to_hex8", f"with {CELLS} select e * 8 + s as elem_id, l as lnode, cx * 2 + s % 2 + {CORNERS}[l + 1][1] as i, cy * 2 + (s // 2) % 2 + {CORNERS}[l + 1][2] as j, cz * 2 + s // 4 + {CORNERS}[l + 1][3] as k from (select *, unnest(range(8)) as l from (select *, unnest(range(8)) as s from cells))")
def _(spark, d):
    return _placed(convert.convert_to(lattice.to_semistructured(cube(spark, d), 2), "HEX8"), 2 * cells(spark, d))


@query("lattice_derefined", f"with {CELLS} select e as elem_id, l as lnode, cx * 2 + l % 3 as i, cy * 2 + (l // 3) % 3 as j, cz * 2 + l // 9 as k from (select *, unnest(range(27)) as l from cells)")
def _(spark, d):
    return _placed(lattice.derefine(lattice.to_semistructured(cube(spark, d), 4, hierarchical=True), 2), 2 * cells(spark, d))


_LEVEL = "case when {0} then 1 when {1} then 2 else 4 end"


@query("lattice_levels", f"with {DIMS} select i, j, k, {_LEVEL.format('i % 4 = 0 and j % 4 = 0 and k % 4 = 0', 'i % 2 = 0 and j % 2 = 0 and k % 2 = 0')} as level from {_grid(4)}")
def _(spark, d):
    n = cells(spark, d)
    m = lattice.to_semistructured(cube(spark, d), 4, hierarchical=True)
    level = F.when(F.col("node_id") < (n + 1) ** 3, 1).when(F.col("node_id") < (2 * n + 1) ** 3, 2).otherwise(4)
    return _at(m, 4 * n).select("i", "j", "k", level.alias("level"))


@query(
    "lattice_surface",
    f"""with {CELLS}, sd as (select *, unnest(range(6)) as lfi from cells),
on_ as (select e, cx, cy, cz, lfi, {SIDES}[lfi + 1] as s from sd where (lfi = 0 and cy = 0) or (lfi = 1 and cx = n - 1) or (lfi = 2 and cy = n - 1) or (lfi = 3 and cx = 0) or (lfi = 4 and cz = 0) or (lfi = 5 and cz = n - 1)),
q as (select *, {CORNERS}[s[1] + 1] as o, {CORNERS}[s[2] + 1] as u, {CORNERS}[s[4] + 1] as v from on_),
c as (select *, sub % 2 + [0, 1, 1, 0][l + 1] as a, sub // 2 + [0, 0, 1, 1][l + 1] as b from (select *, unnest(range(4)) as l from (select *, unnest(range(4)) as sub from q)))
select e as parent, lfi, sub, l as lnode, cx * 2 + o[1] * 2 + (u[1] - o[1]) * a + (v[1] - o[1]) * b as i, cy * 2 + o[2] * 2 + (u[2] - o[2]) * a + (v[2] - o[2]) * b as j, cz * 2 + o[3] * 2 + (u[3] - o[3]) * a + (v[3] - o[3]) * b as k from c""",
)
def _(spark, d):
    m = lattice.to_semistructured(cube(spark, d), 2)
    quads = convert.side_surface_quads(m, materialize(sets.skin_sideset(m)))
    rows = quads.select("parent", F.col("lfi").cast("long").alias("lfi"), F.col("sub").cast("long").alias("sub"), F.posexplode("nodes").alias("lnode", "node_id"))
    return rows.withColumn("lnode", F.col("lnode").cast("long")).join(_at(m, 2 * cells(spark, d)), "node_id").drop("node_id")


@query("lattice_skin_nodes", f"with {DIMS} select i, j, k from {_grid(2)}, dims where i in (0, 2 * n) or j in (0, 2 * n) or k in (0, 2 * n)")
def _(spark, d):
    m = lattice.to_semistructured(cube(spark, d), 2)
    return sets.nodeset(m, materialize(sets.skin_sideset(m))).join(_at(m, 2 * cells(spark, d)), "node_id").select("i", "j", "k")


def _count(c: str, level: int) -> str:
    return f"case when {c} % {level} = 0 and {c} > 0 and {c} < n * {level} then 2::bigint else 1 end"


@query("lattice_incidence", f"with {DIMS} select i, j, k, ({_count('i', 2)}) * ({_count('j', 2)}) * ({_count('k', 2)}) as n_elements from {_grid(2)}, dims")
def _(spark, d):
    m = lattice.to_semistructured(cube(spark, d), 2)
    return transfer.multiplicity(m).join(_at(m, 2 * cells(spark, d)), "node_id").select("i", "j", "k", F.col("n").alias("n_elements"))


def _levels(spark, d, make, kind=None):
    m = lattice.to_semistructured(make(spark, d) if kind is None else make(spark, d, kind), 4, hierarchical=True)
    return m, lattice.derefine(m, 2)


def _interpolated(names: str) -> str:
    """Tensor-product interpolation of the field from a lattice to one twice as fine."""
    axes = [f"(select c // 2 + s as {c}c, case when s = 1 then (c % 2) / 2.0::double else 1 - (c % 2) / 2.0::double end as w{c} from (select {c} as c, unnest([0, 1]) as s) where s = 0 or c % 2 = 1) as x{c}" for c in names]
    value = FIELD.format(*[f"{c}c" for c in names], *["0"] * (3 - len(names)))
    return f"select {', '.join(names)}, round(sum({' * '.join(f'w{c}' for c in names)} * {value}), 9) as value from {_grid(4, names)}, " + ", ".join(f"lateral {a}" for a in axes) + f" group by {', '.join(names)}"


def _gathered(names: str, also: str = "true", where: str = "true") -> str:
    """The transpose: sums over the finer nodes around each coarser one; of pairs that fulfil `also`."""
    axes = [f"(select unnest([-1, 0, 1]) as d{c}) as x{c}" for c in names]
    fine = [f"(2 * {c} + d{c})" for c in names]
    inside = " and ".join(f"{f} between 0 and 4 * n" for f in fine)
    w = " * ".join(f"(1 - abs(d{c}) / 2.0::double)" for c in names)
    value = FIELD.format(*fine, *["0"] * (3 - len(names)))
    return f"select {', '.join(names)}, round(sum({w} * {value}), 9) as value from {_grid(2, names)}, dims, " + ", ".join(f"lateral {a}" for a in axes) + f" where {inside} and ({also}) and ({where}) group by {', '.join(names)}"


@query("lattice_prolongation", f"with {DIMS} {_interpolated('ijk')}")
def _(spark, d):
    n = cells(spark, d)
    fine, coarse = _levels(spark, d, cube)
    return _told(transfer.prolongate_level(fine, coarse, _valued(coarse, 2 * n)), fine, 4 * n)


@query("lattice_restriction", f"with {DIMS} {_gathered('ijk')}")
def _(spark, d):
    n = cells(spark, d)
    fine, coarse = _levels(spark, d, cube)
    return _told(transfer.Restrict(fine, coarse).apply(_valued(fine, 4 * n)), coarse, 2 * n)


_FACES = " or ".join(f"({c} = {s} and d{c} = 0)" for c in "ijk" for s in ("0", "2 * n"))


@query("surface_restriction", f"with {DIMS} {_gathered('ijk', also=_FACES)}")
def _(spark, d):
    n = cells(spark, d)
    fine, coarse = _levels(spark, d, cube)
    r = transfer.SurfaceRestrict(fine, coarse, materialize(sets.skin_sideset(fine)))
    return _told(r.apply(_valued(fine, 4 * n)), coarse, 2 * n)


# Quadrilateral lattices over the square.


@query("quad_lattice_elements", f"with {FLAT} select e as elem_id, l as lnode, (e % n) * 3 + l % 4 as i, (e // n) * 3 + l // 4 as j from (select *, unnest(range(16)) as l from flat)")
def _(spark, d):
    return _placed(lattice.to_semistructured(square(spark, d, "QUAD4"), 3), 3 * cells(spark, d), "ij")


@query("quad_lattice_points", f"with {DIMS} select i, j from {_grid(3, 'ij')}")
def _(spark, d):
    return _at(lattice.to_semistructured(square(spark, d, "QUAD4"), 3), 3 * cells(spark, d), "ij").select("i", "j")


@query("quad_lattice_to_quad4", f"with {FLAT} select e * 9 + s as elem_id, l as lnode, (e % n) * 3 + s % 3 + [0, 1, 1, 0][l + 1] as i, (e // n) * 3 + s // 3 + [0, 0, 1, 1][l + 1] as j from (select *, unnest(range(4)) as l from (select *, unnest(range(9)) as s from flat))")
def _(spark, d):
    return _placed(convert.convert_to(lattice.to_semistructured(square(spark, d, "QUAD4"), 3), "QUAD4"), 3 * cells(spark, d), "ij")


@query("quad_lattice_levels", f"with {DIMS} select i, j, {_LEVEL.format('i % 4 = 0 and j % 4 = 0', 'i % 2 = 0 and j % 2 = 0')} as level from {_grid(4, 'ij')}")
def _(spark, d):
    n = cells(spark, d)
    m = lattice.to_semistructured(square(spark, d, "QUAD4"), 4, hierarchical=True)
    level = F.when(F.col("node_id") < (n + 1) ** 2, 1).when(F.col("node_id") < (2 * n + 1) ** 2, 2).otherwise(4)
    return _at(m, 4 * n, "ij").select("i", "j", level.alias("level"))


@query("quad_lattice_incidence", f"with {DIMS} select i, j, ({_count('i', 2)}) * ({_count('j', 2)}) as n_elements from {_grid(2, 'ij')}, dims")
def _(spark, d):
    m = lattice.to_semistructured(square(spark, d, "QUAD4"), 2)
    return transfer.multiplicity(m).join(_at(m, 2 * cells(spark, d), "ij"), "node_id").select("i", "j", F.col("n").alias("n_elements"))


@query("quad_lattice_prolongation", f"with {DIMS} {_interpolated('ij')}")
def _(spark, d):
    n = cells(spark, d)
    fine, coarse = _levels(spark, d, square, "QUAD4")
    return _told(transfer.prolongate_level(fine, coarse, _valued(coarse, 2 * n, "ij")), fine, 4 * n, "ij")


@query("quad_lattice_restriction", f"with {DIMS} {_gathered('ij')}")
def _(spark, d):
    n = cells(spark, d)
    fine, coarse = _levels(spark, d, square, "QUAD4")
    return _told(transfer.Restrict(fine, coarse).apply(_valued(fine, 4 * n, "ij")), coarse, 2 * n, "ij")


@query(
    "quad_prolongation_matrix",
    f"""with {DIMS}, f as (select i, j from {_grid(4, 'ij')}),
w as (select i, j, i // 2 + s as ic, j // 2 + t as jc, (case when s = 1 then (i % 2) / 2.0::double else 1 - (i % 2) / 2.0::double end) * (case when t = 1 then (j % 2) / 2.0::double else 1 - (j % 2) / 2.0::double end) as value from (select *, unnest([0, 1]) as t from (select *, unnest([0, 1]) as s from f)))
select i, j, ic, jc, value, count(*) over (partition by i, j) as row_length from w where value > 0""",
)
def _(spark, d):
    n = cells(spark, d)
    fine, coarse = _levels(spark, d, square, "QUAD4")
    pointers, entries = transfer.prolongation_matrix(transfer.level_weights(fine, coarse), (4 * n + 1) ** 2)
    pointers = materialize(pointers)
    length = pointers.join(pointers.select((F.col("row") - 1).alias("row"), F.col("start").alias("stop")), "row").select("row", (F.col("stop") - F.col("start")).alias("row_length"), "start", "stop")
    rows = _at(fine, 4 * n, "ij").withColumnRenamed("node_id", "row")
    cols = _at(coarse, 2 * n, "ij").select(F.col("node_id").alias("col"), F.col("i").alias("ic"), F.col("j").alias("jc"))
    got = entries.select(F.col("i").alias("row"), F.col("j").alias("col"), "value", "k").join(length, "row").where("k >= start and k < stop")
    return got.join(rows, "row").join(cols, "col").select("i", "j", "ic", "jc", "value", "row_length")


@query("lattice_node_to_node", f"with {DIMS}, a as (select i, j, k, n from dims, lateral (select unnest(range(n * 2 + 1)) as i) ri, lateral (select unnest(range(n * 2 + 1)) as j) rj, lateral (select unnest(range(n * 2 + 1)) as k) rk), s as (select unnest([-1, 0, 1]) as s) select i, j, k, i + x.s as ni, j + y.s as nj, k + z.s as nk from a, s x, s y, s z where i + x.s between 0 and 2 * n and j + y.s between 0 and 2 * n and k + z.s between 0 and 2 * n")
def _(spark, d):
    """Neighbours over the micro elements of level 2, by where both nodes are."""
    n = cells(spark, d)
    # Places go to an element's nodes, not to the pairs that are made of them.
    pairs = graph.micro_node_to_node(geometry.located(lattice.to_semistructured(cube(spark, d), 2)))
    return pairs.select(*[F.round(F.col(f"{p}.{c}").cast("double") * (2 * n)).cast("long").alias(a) for p, names in (("i", "ijk"), ("j", ("ni", "nj", "nk"))) for c, a in zip("xyz", names)])
