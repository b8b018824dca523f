"""More registered queries: conversion, orderings, geometry, transfer, partitions, arrays."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.quadrature import gauss_lobatto
from ..operators import arrays, convert, distance, geometry, graph, lattice, order, partition, project, regions, sets, solve, transfer
from ..sources import generate as G
from ..storage import materialize
from . import spelled
from .registry import CELLS, CLOUD, DIMS, FLATPTS, HEX, INC, PTS, QUAD, TET, TETPTS, TRI, _rounded, cells, cloud, cube, edges_sql, query, sides_sql, square, sub_sql, table, vector

# --- conversion and promotion ------------------------------------------------------------------------------------------


@query("convert_hex8_to_tet4", f"with {HEX}, o as ({sub_sql(spelled.HEX8_TO_TET4)}) select e as elem_id, nodes from o")
def _(spark, d):
    return convert.convert_to(cube(spark, d), "TET4").elements.select("elem_id", "nodes")


@query("convert_quad4_to_tri3", f"with {QUAD}, o as ({sub_sql(spelled.QUAD4_TO_TRI3)}) select e as elem_id, nodes from o")
def _(spark, d):
    return convert.convert_to(square(spark, d, "QUAD4"), "TRI3").elements.select("elem_id", "nodes")


WEDGE = f"{TRI}, up as (select e, list_concat(nodes, [v + w * w for v in nodes]) as nodes from (select el.e, nodes, n + 1 as w from el, dims))"


@query("convert_wedge6_to_tet4", f"with {WEDGE}, o as ({sub_sql(spelled.WEDGE6_TO_TET4, 'up')}) select e as elem_id, nodes from o")
def _(spark, d):
    return convert.convert_to(convert.extrude(square(spark, d, "TRI3"), 1.0, 1), "TET4").elements.select("elem_id", "nodes")


@query("convert_proteus_hex8", f"with {HEX} select e as elem_id, [nodes[1], nodes[2], nodes[4], nodes[3], nodes[5], nodes[6], nodes[8], nodes[7]] as nodes from el")
def _(spark, d):
    return convert.convert_to(cube(spark, d), "PROTEUS_HEX8").elements.select("elem_id", "nodes")


P2 = f"ed as ({edges_sql('TET4')}), nn as (select (n + 1) * (n + 1) * (n + 1) + n * n * n as nn from dims), en as (select i, j, row_number() over (order by i, j) - 1 + nn as v from ed, nn)"
P2EL = f"p2 as (select s.e // 6 as e, s.e % 6 as k, en.v from ({sub_sql(spelled.EDGES['TET4'])}) s join en on en.i = least(nodes[1], nodes[2]) and en.j = greatest(nodes[1], nodes[2])), t10 as (select el.e, list_concat(any_value(el.nodes), list(p2.v order by k)) as nodes from el join p2 using (e) group by el.e)"


@query("promote_tet10", f"with {TET}, {P2}, {P2EL} select e as elem_id, nodes from t10")
def _(spark, d):
    return convert.promote_to(cube(spark, d, "TET4"), "TET10").elements.select("elem_id", "nodes")


@query("promote_tet10_points", f"with {TET}, {TETPTS}, {P2} select node_id, x, y, z from pts union all select v, cast((a.x + b.x) / 2 as float), cast((a.y + b.y) / 2 as float), cast((a.z + b.z) / 2 as float) from en join pts a on a.node_id = i join pts b on b.node_id = j")
def _(spark, d):
    return convert.promote_to(cube(spark, d, "TET4"), "TET10").points


@query("promote_tri6", f"with {TRI}, ed as ({edges_sql('TRI3')}), en as (select i, j, row_number() over (order by i, j) - 1 + (n + 1) * (n + 1) as v from ed, dims), m as (select s.e // 3 as e, s.e % 3 as k, en.v from ({sub_sql(spelled.EDGES['TRI3'])}) s join en on en.i = least(nodes[1], nodes[2]) and en.j = greatest(nodes[1], nodes[2])) select el.e as elem_id, list_concat(any_value(el.nodes), list(m.v order by k)) as nodes from el join m using (e) group by el.e")
def _(spark, d):
    return convert.promote_to(square(spark, d, "TRI3"), "TRI6").elements.select("elem_id", "nodes")


@query("promote_tet15", f"with {TET}, {P2}, {P2EL}, {sides_sql('TET4')}, ne as (select count(*) as ne from en), fa as (select key, row_number() over (order by min((e, lfi))) - 1 + nn + ne as v from si, nn, ne group by key, nn, ne), nf as (select count(*) as nf from fa), fs as (select e, list(v order by lfi) as f from si join fa using (key) group by e) select t10.e as elem_id, list_concat(list_concat(nodes, f), [nn + ne + nf + t10.e]) as nodes from t10 join fs using (e), nn, ne, nf")
def _(spark, d):
    return convert.promote_to(cube(spark, d, "TET4"), "TET15").elements.select("elem_id", "nodes")


@query("convert_tet15_to_hex8_volume", f"with {DIMS} select n * n * n * 48 as n_elements, cast(1 as double) as volume from dims")
def _(spark, d):
    m = convert.promote_to(cube(spark, d, "TET4"), "TET15")
    m = replace(m, elements=materialize(m.elements))
    # Coordinates go to the 15 nodes of an element, not to the 96 corners of the tetrahedra that it falls into.
    tets = convert.convert_to(convert.convert_to(geometry.located(m), "HEX8"), "TET4")
    v = geometry.volumes(tets).agg(F.round(F.sum("volume"), 3).alias("volume"))
    return convert.convert_to(m, "HEX8").elements.agg(F.count("*").alias("n_elements")).crossJoin(v)


@query("refine_tet4", f"with {TET}, {P2}, {P2EL}, o as ({sub_sql(spelled.TET10_TO_TET4, 't10')}) select e as elem_id, nodes from o")
def _(spark, d):
    return convert.refine(cube(spark, d, "TET4")).elements.select("elem_id", "nodes")


@query("refine_tri3_twice_counts", f"with {DIMS} select 32 * n * n as n_elements, (4 * n + 1) * (4 * n + 1) as n_nodes from dims")
def _(spark, d):
    m = convert.refine(square(spark, d, "TRI3"), 2)
    return m.elements.agg(F.count("*").alias("n_elements")).crossJoin(m.points.agg(F.count("*").alias("n_nodes")))


@query("refine_hex8_counts", f"with {DIMS} select 8 * n * n * n as n_elements, (2 * n + 1) * (2 * n + 1) * (2 * n + 1) as n_nodes, cast(1 as double) as volume from dims")
def _(spark, d):
    m = convert.refine(cube(spark, d))
    a = m.incidence().agg(F.count_distinct("elem_id").alias("n_elements"), F.count_distinct("node_id").alias("n_nodes"))
    return a.crossJoin(geometry.volumes(m).agg(F.round(F.sum("volume"), 4).alias("volume")))


@query("extrude_quad4", f"with {QUAD}, o as (select e + l * n * n as elem_id, list_concat([v + l * (n + 1) * (n + 1) for v in nodes], [v + (l + 1) * (n + 1) * (n + 1) for v in nodes]) as nodes from (select el.e, nodes, n, unnest(range(3)) as l from el, dims)) select * from o")
def _(spark, d):
    return convert.extrude(square(spark, d, "QUAD4"), 1.5, 3).elements.select("elem_id", "nodes")


@query("extrude_points", f"with {DIMS}, {FLATPTS} select node_id + l * (n + 1) * (n + 1) as node_id, x, y, cast(l * 0.5 as float) as z from (select pts.*, n, unnest(range(4)) as l from pts, dims)")
def _(spark, d):
    return convert.extrude(square(spark, d, "QUAD4"), 1.5, 3).points


@query("concatenate", f"with {HEX} select e as elem_id, nodes from el union all select e + n * n * n, [v + (n + 1) * (n + 1) * (n + 1) for v in nodes] from (select el.e, nodes, n from el, dims)")
def _(spark, d):
    m = cube(spark, d)
    return convert.concatenate(m, m).elements.select("elem_id", "nodes")


# --- orderings ---------------------------------------------------------------------------------------------------------

BOX = "bx as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, min(z) as lz, max(z) as hz from cl)"
Q = f"{CLOUD}, {BOX}, q as (select node_id, cast(floor((x::double - lx::double) / (hx::double - lx::double) * 1023 + 0.5) as bigint) as a, cast(floor((y::double - ly::double) / (hy::double - ly::double) * 1023 + 0.5) as bigint) as b, cast(floor((z::double - lz::double) / (hz::double - lz::double) * 1023 + 0.5) as bigint) as c from cl, bx)"


def _spread_sql(v: str) -> str:
    return "(" + " | ".join(f"((({v} >> {k}) & 1) << {3 * k})" for k in range(10)) + ")"


def _doubled(p):
    return p.select("node_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@query("bounding_box", f"with {CLOUD}, {BOX} select lx as min_x, hx as max_x, ly as min_y, hy as max_y, lz as min_z, hz as max_z from bx")
def _(spark, d):
    return cloud(spark, d).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


@query("morton_keys", f"with {Q} select node_id, {_spread_sql('a')} | ({_spread_sql('b')} << 1) | ({_spread_sql('c')} << 2) as key from q")
def _(spark, d):
    return order.curve_keys(_doubled(cloud(spark, d)), "morton3", ids=("node_id",))


@query("cartesian_keys", f"with {Q} select node_id, a + 1024 * (b + 1024 * c) as key from q")
def _(spark, d):
    return order.curve_keys(_doubled(cloud(spark, d)), "cartesian3", ids=("node_id",))


def _hilbert_sql() -> str:
    """Skilling's transform unrolled: a CTE for each step."""
    out, prev = [], "h0"
    ctes = ["h0 as (select node_id, a as x0, b as x1, c as x2 from q)"]
    k = 0
    for bit in range(9, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(3):
            k += 1
            cols = {0: "x0", 1: "x1", 2: "x2"}
            t = f"(xor(x0, x{i}) & {p})"
            new0 = f"case when x{i} & {q} <> 0 then xor(x0, {p}) else xor(x0, {t}) end"
            cols[0] = f"{new0} as x0" if i else f"case when x0 & {q} <> 0 then xor(x0, {p}) else x0 end as x0"
            if i:
                cols[i] = f"case when x{i} & {q} <> 0 then x{i} else xor(x{i}, {t}) end as x{i}"
            ctes.append(f"h{k} as (select node_id, {', '.join(cols.values())} from {prev})")
            prev = f"h{k}"
    ctes.append(f"g as (select node_id, x0, xor(x1, x0) as x1, xor(x2, xor(x1, x0)) as x2 from {prev})")
    t = "0"
    for bit in range(9, 0, -1):
        t = f"xor({t}, case when x2 & {1 << bit} <> 0 then {(1 << bit) - 1} else 0 end)"
    ctes.append(f"u as (select node_id, x0, x1, x2, {t} as t from g), w as (select node_id, xor(x0, t) as x0, xor(x1, t) as x1, xor(x2, t) as x2 from u)")
    out = f"select node_id, ({_spread_sql('x0')} << 2) | ({_spread_sql('x1')} << 1) | {_spread_sql('x2')} as key from w"
    return f"with {Q}, " + ", ".join(ctes) + " " + out


@query("hilbert_keys", _hilbert_sql())
def _(spark, d):
    return order.curve_keys(_doubled(cloud(spark, d)), "hilbert3", ids=("node_id",))


@query("random_keys")
def _(spark, d):
    return order.curve_keys(cloud(spark, d), "random3", ids=("node_id",))


@query("sfc_reorder_cartesian", f"with {HEX}, i as (select e, k, nodes[k + 1] as v from (select *, unnest(range(8)) as k from el)), f as (select v, row_number() over (order by m) - 1 as nid from (select v, min((e, k)) as m from i group by v)) select e as elem_id, list(nid order by k) as nodes from i join f using (v) group by e")
def _(spark, d):
    return order.reorder(cube(spark, d), "cartesian3").elements.select("elem_id", "nodes")


@query("sfc_reorder_morton_counts", f"with {DIMS} select n * n * n as n_elements, (n + 1) * (n + 1) * (n + 1) as n_nodes, cast(0 as bigint) as first_node from dims")
def _(spark, d):
    m = order.reorder(cube(spark, d), "morton3")
    return m.incidence().agg(F.count_distinct("elem_id").alias("n_elements"), F.count_distinct("node_id").alias("n_nodes"), F.min("node_id").alias("first_node"))


@query("l2_projection", f"with {DIMS}, {PTS} select node_id as id, round(1 + 2 * x::double - 3 * y::double + 0.5 * z::double, 6) + 0.0 as value from pts")
def _(spark, d):
    """A linear function is its own projection."""
    return project.l2_projection(cube(spark, d), 1 + 2 * F.col("x") - 3 * F.col("y") + 0.5 * F.col("z")).select("id", (F.round("value", 6) + 0.0).alias("value"))


@query("l2_loads", f"with {CELLS} select e as elem_id, k, round((cx + case when k in (1, 2, 5, 6) then 2.0 / 3 else 1.0 / 3 end)::double, 3) as value from (select *, unnest(range(8)) as k from cells)")
def _(spark, d):
    """Integrals of x against the corners' functions, in closed form, in units of an eighth of a cell's size and length."""
    mesh, n = cube(spark, d), cells(spark, d)
    b = project.l2_loads(project.quadrature_points(mesh), F.col("x"))
    long = b.select("elem_id", F.posexplode(F.array(*[f"b{k}" for k in range(8)])).alias("k", "value"))
    return long.select("elem_id", "k", F.round(F.col("value") * (8.0 * n**4), 3).alias("value"))


@query("lattice_micro_adjugate", f"with {DIMS} select e as elem_id, k, round(case when k in (0, 4, 8) then 1.0 / (9 * n * n) when k = 9 then 1.0 / (27 * n * n * n) else 0.0 end, 7) + 0.0 as value from (select n, unnest(range(n * n * n)) as e from dims), lateral (select unnest(range(10)) as k)")
def _(spark, d):
    """Of a third of a cell: nine entries of the adjugate and the determinant."""
    a = project.micro_adjugate(project.macro_adjugate(lattice.to_semistructured(cube(spark, d), 3)), 3)
    long = a.select("elem_id", F.posexplode(F.array(*[f"a{k}" for k in range(9)], "det")).alias("k", "value"))
    return long.select("elem_id", "k", (F.round("value", 7) + 0.0).alias("value"))


@query("lattice_macro_fff", f"with {DIMS} select e as elem_id, k, round(case when k in (0, 3, 5) then 1.0 / n else 0.0 end, 5) + 0.0 as value from (select n, unnest(range(n * n * n)) as e from dims), lateral (select unnest(range(6)) as k)")
def _(spark, d):
    f = project.macro_fundamental_form(lattice.to_semistructured(cube(spark, d), 2))
    long = f.select("elem_id", F.posexplode(F.array(*[f"f{k}" for k in range(6)])).alias("k", "value"))
    return long.select("elem_id", "k", (F.round("value", 5) + 0.0).alias("value"))


def _bandwidth_sql(levels: int) -> str:
    """Levels of the numbering written out: l<k>(node, place); at every step the least place before, then degree, then id."""
    out = "dg as (select i, count(*) as d from g group by i), l0 as (select i as node, 0::bigint as place from dg order by d, i limit 1)"
    for k in range(1, levels + 1):
        seen = " union all ".join(f"select node from l{i}" for i in range(max(0, k - 2), k))
        out += f", r{k} as (select j, min(place) as parent from l{k - 1} join g on g.i = node where j not in ({seen}) group by j), l{k} as (select j as node, row_number() over (order by parent, d, j) - 1 + (select max(place) + 1 from l{k - 1}) as place from r{k} join dg on dg.i = j)"
    return out


@query("cuthill_mckee", f"with {TRI}, {INC}, g as (select distinct a.v as i, b.v as j from inc a join inc b using (e)), {_bandwidth_sql(72)} {' union all '.join(f'select node, place as new_id from l{k}' for k in range(73))}")
def _(spark, d):
    n = cells(spark, d)
    return order.cuthill_mckee(graph.node_to_node(square(spark, d, "TRI3")), (n + 1) ** 2)


# --- geometry ----------------------------------------------------------------------------------------------------------

CORN = "co as (select e, k, x::double as x, y::double as y, z::double as z from (select e, unnest(range(len(nodes))) as k, unnest(nodes) as node_id from el) join pts using (node_id))"
TETJ = f"{TET}, {TETPTS}, {CORN}, w as (select e, max(x) filter (k = 0) as x0, max(y) filter (k = 0) as y0, max(z) filter (k = 0) as z0, " + ", ".join(f"max({c}) filter (k = {k}) as {c}{k}" for k in (1, 2, 3) for c in "xyz") + " from co group by e), j as (select e, " + ", ".join(f"{c}{k} - {c}0 as j{r}{k - 1}" for r, c in enumerate("xyz") for k in (1, 2, 3)) + " from w)"


def _minor(r: int, c: int) -> str:
    a, b, p, q = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3
    return f"(j{a}{p} * j{b}{q} - j{a}{q} * j{b}{p})"


ADJ = ", ".join(f"{_minor(c, r)} as a{3 * r + c}" for r in range(3) for c in range(3))
DET = f"(j00 * {_minor(0, 0)} + j01 * {_minor(0, 1)} + j02 * {_minor(0, 2)})"


def _near(names: str, digits: int = 7) -> str:
    return ", ".join(f"round({c}, {digits}) + 0 as {c}" for c in names.split())


@query("barycenters", f"with {TET}, {TETPTS}, {CORN} select e as elem_id, round(avg(x), 5) + 0 as x, round(avg(y), 5) + 0 as y, round(avg(z), 5) + 0 as z from co group by e")
def _(spark, d):
    return _rounded(sets.centroids(cube(spark, d, "TET4")).drop("block_id"), "x", "y", "z")


@query("tet4_adjugate", f"with {TETJ}, a as (select e, {ADJ}, {DET} as det from j) select e as elem_id, {_near(' '.join(f'a{k}' for k in range(9)) + ' det')} from a")
def _(spark, d):
    return _rounded(geometry.adjugate_and_determinant(cube(spark, d, "TET4")).drop("block_id"), *[f"a{k}" for k in range(9)], "det", digits=7)


@query("tet4_fff", f"with {TETJ}, a as (select e, {ADJ}, {DET} as det from j), f as (select e, " + ", ".join(f"(a{3 * r} * a{3 * s} + a{3 * r + 1} * a{3 * s + 1} + a{3 * r + 2} * a{3 * s + 2}) / (6 * det) as f{k}" for k, (r, s) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) + f", det / 6 as det from a) select e as elem_id, {_near('f0 f1 f2 f3 f4 f5', 5)}, round(det, 7) + 0 as det from f")
def _(spark, d):
    f = geometry.fundamental_form(cube(spark, d, "TET4")).drop("block_id")
    return _rounded(_rounded(f, *[f"f{k}" for k in range(6)], digits=5), "det", digits=7)


@query("hex8_adjugate", f"with {CELLS} select e as elem_id, round(1.0::double / (n * n), 6) + 0 as a0, round(1.0::double / (n * n), 6) + 0 as a4, round(1.0::double / (n * n), 6) + 0 as a8, 0.0::double as a1, round(1.0::double / (n * n * n), 6) + 0 as det from cells")
def _(spark, d):
    a = geometry.adjugate_and_determinant(cube(spark, d))
    return _rounded(a.select("elem_id", "a0", "a4", "a8", "a1", "det"), "a0", "a4", "a8", "a1", "det", digits=6)


@query("hex8_fff", f"with {CELLS} select e as elem_id, round(1.0::double / n, 4) + 0 as f0, 0.0::double as f1, round(1.0::double / n, 4) + 0 as f3, round(1.0::double / n, 4) + 0 as f5 from cells")
def _(spark, d):
    return _rounded(geometry.fundamental_form(cube(spark, d)).select("elem_id", "f0", "f1", "f3", "f5"), "f0", "f1", "f3", "f5", digits=4)


@query("hex8_diagonal", f"with {CELLS} select e as elem_id, round(1.0::double / n, 5) + 0 as dx, round(1.0::double / n, 5) + 0 as dy, round(1.0::double / n, 5) + 0 as dz from cells")
def _(spark, d):
    return _rounded(geometry.axis_aligned_diagonal(cube(spark, d)).drop("block_id"), "dx", "dy", "dz")


@query("volumes", f"with {DIMS} select 12 * n * n * n as n_elements, cast(1 as double) as volume, cast(0 as bigint) as n_inverted from dims")
def _(spark, d):
    return geometry.volumes(cube(spark, d, "TET4")).agg(F.count("*").alias("n_elements"), F.round(F.sum("volume"), 6).alias("volume"), F.sum((F.col("volume") <= 0).cast("long")).alias("n_inverted"))


@query("face_normals", f"with {TRI} select e as elem_id, 0.0::double as nx, 0.0::double as ny, 1.0::double as nz from el")
def _(spark, d):
    return _rounded(sets.face_normals(square(spark, d, "TRI3")).drop("block_id"), "nx", "ny", "nz", digits=6)


@query("node_normals", f"with {QUAD}, {INC} select distinct v as node_id, 0.0::double as nx, 0.0::double as ny, 1.0::double as nz from inc")
def _(spark, d):
    return _rounded(geometry.node_normals(square(spark, d, "QUAD4")), "nx", "ny", "nz", digits=6)


_OUTER = " or ".join(f"{c} <= 0 or {c} >= 0.999999" for c in "xyz")


@query("nearest_surface_distance", f"with {DIMS}, {PTS}, {CLOUD}, s as (select x::double as x, y::double as y, z::double as z from pts where {_OUTER}) select a.node_id, round(min(sqrt((a.x::double - b.x) ** 2 + (a.y::double - b.y) ** 2 + (a.z::double - b.z) ** 2)), 6) as distance from cl a, s b group by 1")
def _(spark, d):
    """From every point of the cloud to the nearest node of the cube's surface."""
    surface = _doubled(cube(spark, d).points).where(_OUTER)
    return geometry.signed_distance(_doubled(cloud(spark, d)), surface).withColumn("distance", F.round("distance", 6))


#: The skin's triangles of a cube, spelt out: the six sides of a cell on the boundary, each cut from its first corner.
_SKIN = f"""{HEX}, {PTS}, sd as (select e, unnest([[0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7], [0, 3, 2, 1], [4, 5, 6, 7]]) as f, nodes from el),
fc as (select e, [nodes[k + 1] for k in f] as q from sd), once as (select any_value(q) as q from fc group by list_sort(q) having count(*) = 1),
tv as (select unnest([[q[1], q[2], q[3]], [q[1], q[3], q[4]]]) as v, row_number() over () as r from once),
tr as (select a.x::double as ax, a.y::double as ay, a.z::double as az, b.x::double - a.x as ux, b.y::double - a.y as uy, b.z::double - a.z as uz, c.x::double - a.x as vx, c.y::double - a.y as vy, c.z::double - a.z as vz
from tv join pts a on a.node_id = v[1] join pts b on b.node_id = v[2] join pts c on c.node_id = v[3])"""
#: Closest point by regions of the plane's barycentric coordinates: inside, or else the nearest of the three edges.
_TO_TRIANGLE = """pr as (select node_id, x, y, z, ux, uy, uz, vx, vy, vz, x - ax as px, y - ay as py, z - az as pz from cl, tr),
dt as (select *, ux*ux+uy*uy+uz*uz as uu, ux*vx+uy*vy+uz*vz as uv, vx*vx+vy*vy+vz*vz as vv, px*ux+py*uy+pz*uz as pu, px*vx+py*vy+pz*vz as pv, px*px+py*py+pz*pz as pp from pr),
bc as (select *, (vv*pu - uv*pv) / (uu*vv - uv*uv) as s, (uu*pv - uv*pu) / (uu*vv - uv*uv) as t from dt),
cp as (select *, case when s >= 0 and t >= 0 and s + t <= 1 then [[s, t]] else [[greatest(0, least(1, pu / uu)), 0.0], [0.0, greatest(0, least(1, pv / vv))], [1 - greatest(0, least(1, (pv - pu - uv + uu) / (uu - 2*uv + vv))), greatest(0, least(1, (pv - pu - uv + uu) / (uu - 2*uv + vv)))]] end as ends from bc),
dd as (select node_id, x, y, z, list_min([(px - e[1]*ux - e[2]*vx)**2 + (py - e[1]*uy - e[2]*vy)**2 + (pz - e[1]*uz - e[2]*vz)**2 for e in ends]) as d2 from cp)"""


@query("signed_surface_distance", f"with {_SKIN}, {CLOUD.replace('embedding[1] as', 'embedding[1]::double as').replace('embedding[2] as', 'embedding[2]::double as').replace('embedding[3] as', 'embedding[3]::double as')}, {_TO_TRIANGLE} select node_id, round(case when x > 0 and x < 1 and y > 0 and y < 1 and z > 0 and z < 1 then -1 else 1 end * sqrt(min(d2)), 9) as distance from dd group by node_id, x, y, z")
def _(spark, d):
    """From every point of the cloud to the cube's skin, negative inside."""
    return distance.distance_to_surface(cloud(spark, d), sets.skin(cube(spark, d))).select("node_id", F.round("distance", 9).alias("distance"))


def _on_edge(mesh):
    """Nodes of the unit square's boundary."""
    return mesh.points.where("x <= 0 or y <= 0 or x >= 0.999999 or y >= 0.999999")


_CUBE_SIDES = "fc as (select e, lfi, list_sort([nodes[k + 1] for k in f]) as key from (select e, unnest(range(6)) as lfi, unnest([[0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7], [3, 2, 1, 0], [4, 5, 6, 7]]) as f, nodes from el)), sk as (select any_value(e) as e, any_value(lfi) as lfi from fc group by key having count(*) = 1)"


@query("surface_patches", f"with {HEX}, {_CUBE_SIDES}, nu as (select row_number() over (order by e, lfi) - 1 as elem_id, lfi from sk) select elem_id, min(elem_id) over (partition by lfi) as patch from nu")
def _(spark, d):
    """The skin of the cube falls into its six faces; its elements are numbered by parent and side."""
    return regions.surface_patches(sets.skin(cube(spark, d)), 0.9)


@query("select_surface", f"with {HEX}, {_CUBE_SIDES}, nu as (select row_number() over (order by e, lfi) - 1 as elem_id, lfi from sk) select elem_id from nu where lfi = 5")
def _(spark, d):
    return regions.select_surface(sets.skin(cube(spark, d)), (0.5, 0.45, 1.2), 0.9)


def _hops_sql(levels: int) -> str:
    """Levels of a queue's search written out: l<k>(node, place), each after the last."""
    out = "l0 as (select 0::bigint as node, 0::bigint as place)"
    for k in range(1, levels + 1):
        seen = " union all ".join(f"select node from l{i}" for i in range(max(0, k - 2), k))
        out += f", r{k} as (select j, min(place) as parent from l{k - 1} join g on g.i = node where j not in ({seen}) group by j), l{k} as (select j as node, row_number() over (order by parent, j) - 1 + (select max(place) + 1 from l{k - 1}) as place from r{k})"
    return out


@query("nodes_by_hops", f"with {HEX}, {INC}, g as (select distinct a.v as i, b.v as j from inc a join inc b using (e)), {_hops_sql(32)}, a as ({' union all '.join(f'select {k} as level, * from l{k}' for k in range(33))}) select node, level, place from a where place < (select (n + 1) * (n + 1) * (n + 1) // 8 from dims) and node is not null")
def _(spark, d):
    """An eighth of the cube's nodes, from its corner along the elements."""
    n = cells(spark, d)
    return regions.nodes_by_hops(graph.node_to_node(cube(spark, d)), 0, (n + 1) ** 3 // 8)


@query("submesh_around", f"with {TET}, {TETPTS}, m as (select count(*) // 10 as m from pts), near as (select node_id from pts order by (x::double - 0.3) ** 2 + (y::double - 0.6) ** 2 + (z::double - 0.2) ** 2, node_id limit (select m from m)), hit as (select distinct e from {'(select e, unnest(nodes) as v from el)'} join near on v = node_id), k as (select e, nodes, row_number() over (order by e) - 1 as elem_id from el join hit using (e)), ids as (select v, row_number() over (order by v) - 1 as w from (select distinct unnest(nodes) as v from k)), f as (select elem_id, unnest(range(4)) as k, unnest(nodes) as v from k) select elem_id, list(w order by k) as nodes from f join ids using (v) group by elem_id")
def _(spark, d):
    mesh = cube(spark, d, "TET4")
    return regions.submesh_around(mesh, (0.3, 0.6, 0.2), mesh.n_nodes() // 10).elements.select("elem_id", "nodes")


@query("poisson_square", f"with {DIMS}, {FLATPTS} select node_id as id, round(x::double * (1 - x::double) * y::double * (1 - y::double), 6) as value from pts")
def _(spark, d):
    """The Poisson problem whose solution is x (1 - x) y (1 - y): on right triangles the scheme is exact for it."""
    mesh, h = square(spark, d, "TRI3"), 1.0 / cells(spark, d)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    load = mesh.points.select(F.col("node_id").alias("id"), (h * h * (2 * x * (1 - x) + 2 * y * (1 - y))).alias("value"))
    zero = _on_edge(mesh).select(F.col("node_id").alias("id"), F.lit(0.0).alias("value"))
    return solve.solve_with_fixed(solve.stiffness(mesh), load, zero, groups=solve.patches(mesh)).values.select("id", F.round("value", 6).alias("value"))


@query("diffused_distance", f"with {DIMS}, {FLATPTS} select node_id as id, round(0.6 * x::double + 0.8 * y::double, 5) as value, round(0.6::double, 5) as x, round(0.8::double, 5) as y from pts")
def _(spark, d):
    """The distance to a plane, known on the square's boundary alone."""
    mesh = square(spark, d, "TRI3")
    known = _on_edge(mesh).select(F.col("node_id").alias("id"), (0.6 * F.col("x").cast("double") + 0.8 * F.col("y").cast("double")).alias("value"), F.lit(0.6).alias("x"), F.lit(0.8).alias("y"), F.lit(0.0).alias("z"))
    out = solve.diffused_distance(mesh, known)
    return out.distance.join(out.normals, "id").select("id", *[F.round(c, 5).alias(c) for c in ("value", "x", "y")])


@query("stiffness_tri3", f"with {QUAD}, w as (select n + 1 as w, n from dims), g as (select i, i % w as x, i // w as y, n, w from w, lateral (select unnest(range(w * w)) as i)), o as (select unnest([[0, 0], [1, 0], [-1, 0], [0, 1], [0, -1], [1, -1], [-1, 1]]) as o) select i, i + o[1] + o[2] * w as j, case when o = [0, 0] then (4.0 - (case when x in (0, n) then 2 else 0 end) - (case when y in (0, n) then 2 else 0 end) + (case when x in (0, n) and y in (0, n) then 1 else 0 end)) when o[1] * o[2] <> 0 then 0.0 when o[1] = 0 then (case when x in (0, n) then -0.5 else -1.0 end) else (case when y in (0, n) then -0.5 else -1.0 end) end::double as value from g, o where x + o[1] between 0 and n and y + o[2] between 0 and n")
def _(spark, d):
    """The matrix of the five-point star, with halves along the boundary."""
    m = solve.stiffness(square(spark, d, "TRI3"))
    return m.select("i", "j", (F.round("value", 3) + 0.0).alias("value"))


@query("gauss_lobatto", "select 3 as n, 0 as k, 0.0::double as x, round(1.0::double / 6, 9) as w union all select 3, 1, 0.5, round(2.0::double / 3, 9) union all select 3, 2, 1.0, round(1.0::double / 6, 9)")
def _(spark, d):
    x, w = gauss_lobatto(3)
    return spark.createDataFrame([(3, k, round(a, 9), round(b, 9)) for k, (a, b) in enumerate(zip(x, w))], "n int, k int, x double, w double")


# --- transfer ---------------------------------------------------------------------------------------------


def _field(mesh, expr):
    return mesh.points.select(F.col("node_id").alias("id"), F.lit(0).alias("comp"), expr.alias("value"))


def _linear():
    return F.col("x").cast("double") + 2 * F.col("y").cast("double") + 3 * F.col("z").cast("double")


@query("p1_to_p2_prolongation", "select cast(true as boolean) as linear_is_exact")
def _(spark, d):
    m = convert.promote_to(cube(spark, d, "TET4"), "TET10")
    p = transfer.prolongate(transfer.p1_weights(m), _field(cube(spark, d, "TET4"), _linear()))
    e = p.join(m.points, F.col("id") == F.col("node_id")).select(F.abs(F.col("value") - _linear()).alias("e"))
    return e.agg((F.max("e") < 1e-5).alias("linear_is_exact"))


@query("p2_to_p1_restriction", f"with {TET}, {INC}, ed as ({edges_sql('TET4')}), deg as (select v, count(*) as c from (select i as v from ed union all select j from ed) group by v) select v as id, 1 + c / 2.0::double as value from deg")
def _(spark, d):
    m = convert.promote_to(cube(spark, d, "TET4"), "TET10")
    return transfer.restrict(transfer.p1_weights(m), _field(m, F.lit(1.0))).select("id", "value")


@query("edge_map_restriction", f"with {TET}, {INC}, ed as ({edges_sql('TET4')}), deg as (select v, count(*) as c from (select i as v from ed union all select j from ed) group by v) select v as id, 1 + c / 2.0::double as value from deg")
def _(spark, d):
    m = cube(spark, d, "TET4")
    n = m.n_nodes()
    numbers = transfer.edge_map(m, n)
    ones = spark.range(n + graph.edges(m).count()).select("id", F.lit(0).alias("comp"), F.lit(1.0).alias("value"))
    return transfer.restrict_edges(ones, numbers, n).select("id", "value")


# --- partitions, exchange and packing ----------------------------------------------------------------------------------

PARTS = 4
PARTSQL = "pt as (select e, nodes, case when e < m * (s + 1) then e // (s + 1) else (e - m * (s + 1)) // s + m end as part from (select el.e, nodes, (n * n * n) // 4 as s, (n * n * n) % 4 as m from el, dims)), ow as (select distinct part, unnest(nodes) as v from pt), mn as (select v, min(part) as owner, max(part) as last from ow group by v), cls as (select part, v, owner, case when part <> owner then 2 when last > owner then 1 else 0 end as class from ow join mn using (v))"


@query("element_parts", f"with {HEX}, {PARTSQL} select e as elem_id, part from pt")
def _(spark, d):
    return partition.element_parts(cube(spark, d), PARTS)


def _parts(spark, d):
    m = cube(spark, d)
    owners = partition.element_parts(m, PARTS)
    return m, owners, partition.node_parts(m, owners)


@query("node_parts", f"with {HEX}, {PARTSQL} select part, v as node_id, owner, class from cls")
def _(spark, d):
    return _parts(spark, d)[2]


@query("local_nodes", f"with {HEX}, {PARTSQL} select part, v as node_id, owner, class, row_number() over (partition by part order by class, v) - 1 as local_id from cls")
def _(spark, d):
    return partition.local_nodes(_parts(spark, d)[2])


@query("local_elements", f"with {HEX}, {PARTSQL}, sh as (select distinct pt.part, e from (select part, e, unnest(nodes) as v from pt) pt join cls on cls.part = pt.part and cls.v = pt.v and class = 2), f as (select pt.part, pt.e, sh.e is not null as shared from pt left join sh on sh.part = pt.part and sh.e = pt.e) select part, e as elem_id, shared, row_number() over (partition by part order by shared, e) - 1 as local_id from f")
def _(spark, d):
    return partition.local_elements(*_parts(spark, d))


@query("aura_elements", f"with {HEX}, {PARTSQL} select distinct cls.part, x.e as elem_id, x.part as owner from (select part, e, unnest(nodes) as v from pt) x join cls on cls.v = x.v and class < 2 where cls.part <> x.part")
def _(spark, d):
    return partition.aura_elements(*_parts(spark, d))


@query("aura_nodes", f"with {HEX}, {PARTSQL}, au as (select distinct cls.part, x.e from (select part, e, unnest(nodes) as v from pt) x join cls on cls.v = x.v and class < 2 where cls.part <> x.part), an as (select distinct au.part, unnest(pt.nodes) as v from au join pt using (e)) select an.part, an.v as node_id, mn.owner from an join mn using (v) where not exists (select 1 from ow where ow.part = an.part and ow.v = an.v)")
def _(spark, d):
    m, owners, nodes = _parts(spark, d)
    return partition.aura_nodes(m, nodes, partition.aura_elements(m, owners, nodes))


@query("owner_numbering", f"with {HEX}, {PARTSQL} select v as node_id, row_number() over (order by part, class, v) - 1 as new_id from cls where class < 2")
def _(spark, d):
    return partition.owner_numbering(_parts(spark, d)[2])


@query("exchange_scatter_add", f"with {HEX}, {PARTSQL} select v as node_id, 0 as comp, sum(part + 1.0::double) as value from cls group by v")
def _(spark, d):
    local = _parts(spark, d)[2].select("part", "node_id", F.lit(0).alias("comp"), (F.col("part") + 1.0).alias("value"))
    return partition.scatter_add(local)


@query("exchange_gather", f"with {HEX}, {PARTSQL} select part, v as node_id, 0 as comp, cast(v as double) as value from cls where class = 2")
def _(spark, d):
    nodes = _parts(spark, d)[2]
    local = nodes.where("class < 2").select("part", "node_id", F.lit(0).alias("comp"), F.col("node_id").cast("double").alias("value"))
    return partition.gather_owned(local, partition.halo(nodes))


@query("partition_report", f"with {HEX}, {PARTSQL}, au as (select distinct cls.part, x.e from (select part, e, unnest(nodes) as v from pt) x join cls on cls.v = x.v and class < 2 where cls.part <> x.part), an as (select distinct au.part, unnest(pt.nodes) as v from au join pt using (e)), ax as (select * from an anti join ow on ow.part = an.part and ow.v = an.v) select part, (select count(*) from pt where pt.part = c.part) as elements, count(*) filter (class = 0) as owned, count(*) filter (class = 1) as shared, count(*) filter (class = 2) as ghosts, (select count(*) from au where au.part = c.part) as aura_elements, (select count(*) from ax where ax.part = c.part) as aura_nodes from cls c group by part")
def _(spark, d):
    return partition.partition_report(cube(spark, d), PARTS)


PACK = f"{HEX}, pk as (select e // 50 as pack, e, unnest(range(8)) as k, unnest(nodes) as v from el), sn as (select pack, v, min((k, e)) as touch from pk group by 1, 2), ps as (select v, min(pack) as owner, max(pack) as last from sn group by v), pc as (select pack, v, touch, case when pack <> owner then 2 when last > owner then 1 else 0 end as class from sn join ps using (v)), pl as (select *, row_number() over (partition by pack order by class, touch) - 1 as local_id from pc), pg as (select v, row_number() over (order by pack, class, touch) - 1 as packed_id from pc where class < 2)"


@query("packed_nodes", f"with {PACK} select pack, v as node_id, class, packed_id, local_id from pl join pg using (v)")
def _(spark, d):
    return partition.packed_nodes(cube(spark, d), 50)


@query("packed_elements", f"with {PACK} select pk.pack, e as elem_id, list(cast(local_id as smallint) order by k) as nodes from pk join pl on pl.pack = pk.pack and pl.v = pk.v group by 1, 2")
def _(spark, d):
    return partition.packed_elements(cube(spark, d), 50)


@query("ghost_reduction", f"with {PACK} select packed_id, count(*) as n, min(pl.pack) as first_pack from pl join pg using (v) where class = 2 group by 1")
def _(spark, d):
    g = partition.ghost_reduction(partition.packed_nodes(cube(spark, d), 50))
    return g.select("packed_id", F.size("sources").cast("long").alias("n"), F.get("sources", F.lit(0))["pack"].alias("first_pack"))


@query("map_to_packed_and_back", f"with {DIMS} select unnest(range((n + 1) * (n + 1) * (n + 1))) as id, 1.0::double as value from dims")
def _(spark, d):
    m = cube(spark, d)
    p = materialize(partition.packed_nodes(m, 50))
    return partition.to_unpacked(partition.to_packed(m.points.select(F.col("node_id").alias("id"), F.lit(1.0).alias("value")), p), p)


# --- arrays ------------------------------------------------------------------------------------------------------------

VEC = "ve as (select p_partkey as id, p_retailprice as value from part)"


def _brand(spark, d):
    return table(spark, d, "part").where("p_size % 7 = 0").select(F.col("p_partkey").alias("id"))


GONE = "gone as (select p_partkey as id from part where p_size % 7 = 0), nn as (select count(*) as n from part)"


@query("create_mask", f"with {GONE}, r as (select unnest(range(n)) as id from nn) select id, id in (select id from gone) as \"on\" from r")
def _(spark, d):
    return arrays.mask(spark, table(spark, d, "part").count(), _brand(spark, d))


@query("mask_bytes", f"with {GONE}, r as (select unnest(range(n)) as id from nn) select id // 8 as byte, cast(sum(case when id in (select id from gone) then 1 << (id % 8)::int else 0 end) as int) as value from r group by 1")
def _(spark, d):
    return arrays.mask_bytes(arrays.mask(spark, table(spark, d, "part").count(), _brand(spark, d)))


@query("idx_to_indicator", f"with {GONE}, r as (select unnest(range(n)) as id from nn) select id, cast(case when id in (select id from gone) then 1 else 0 end as float) as value from r")
def _(spark, d):
    return arrays.indicator(spark, table(spark, d, "part").count(), _brand(spark, d))


@query("axpy", f"with {VEC} select id, round(value + 2.5::double * p_size, 6) as value from ve join part on p_partkey = id")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("value"))
    return arrays.axpy(2.5, x, vector(spark, d)).withColumn("value", F.round("value", 6))


@query("soa_to_aos", f"with {CLOUD} select node_id * 2 as id, x as value from cl union all select node_id * 2 + 1, y from cl")
def _(spark, d):
    c = cloud(spark, d)
    return arrays.soa_to_aos(*[c.select(F.col("node_id").alias("id"), F.col(k).alias("value")) for k in "xy"])


@query("aos_to_soa", f"with {CLOUD} select node_id as id, x as c0, y as c1 from cl")
def _(spark, d):
    c = cloud(spark, d)
    return arrays.aos_to_soa(arrays.soa_to_aos(*[c.select(F.col("node_id").alias("id"), F.col(k).alias("value")) for k in "xy"]), 2)


@query("view", f"with {VEC} select id - 10 as id, value from ve where id between 10 and 99")
def _(spark, d):
    return arrays.view(vector(spark, d), 10, 100)


@query("astype", f"with {VEC} select id, cast(trunc(value) as int) as value from ve")
def _(spark, d):
    return arrays.as_type(vector(spark, d), "int")


@query("zeros_like", f"with {VEC} select id, 0.0::double as value from ve")
def _(spark, d):
    return arrays.zeros_like(vector(spark, d))


@query("gather", f"with {VEC} select l.l_orderkey * 100 + l.l_linenumber as id, ve.value from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) l join ve on ve.id = l.l_partkey")
def _(spark, d):
    i = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source")).distinct()
    return arrays.gather(vector(spark, d), i)


@query("scatter", f"with {VEC}, nn as (select count(*) as n from part) select n - 1 - id as id, value from ve, nn")
def _(spark, d):
    n = table(spark, d, "part").count()
    v = vector(spark, d)
    return arrays.scatter(v, v.select("id", (F.lit(n - 1) - F.col("id")).alias("target")))


@query("override", f"with {VEC}, {GONE} select id, case when id in (select id from gone) then -1.0::double else value end as value from ve")
def _(spark, d):
    return arrays.override(vector(spark, d), _brand(spark, d), -1.0)


@query("set_union", "select l_partkey as id from lineitem where l_quantity > 45 union select p_partkey from part where p_size > 40")
def _(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return arrays.set_union(a, table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")))


@query("set_difference", "select p_partkey as id from part where p_size > 40 except select l_partkey from lineitem where l_quantity > 45")
def _(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return arrays.set_difference(table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")), a)


@query("set_intersection", "select p_partkey as id from part where p_size > 40 intersect select l_partkey from lineitem where l_quantity > 45")
def _(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return arrays.set_intersection(table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id")), a)


@query("unique", "select distinct l_suppkey as id from lineitem")
def _(spark, d):
    return arrays.unique(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id")))


KEEP = f"{GONE}, keep as (select id, row_number() over (order by id) - 1 as k from (select unnest(range(n)) as id from nn) where id not in (select id from gone))"


@query("condense_vector", f"with {VEC}, {KEEP} select k as id, value from ve join keep using (id)")
def _(spark, d):
    return arrays.condensed_vector(vector(spark, d), table(spark, d, "part").count(), _brand(spark, d))


@query("remap_vector", f"with {VEC}, {GONE} select id, case when id in (select id from gone) then 0.0::double else value end as value from ve")
def _(spark, d):
    n = table(spark, d, "part").count()
    gone = _brand(spark, d)
    return arrays.remapped_vector(arrays.condensed_vector(vector(spark, d), n, gone), n, gone)


@query("min_max", "select min(p_retailprice) as min, max(p_retailprice) as max from part")
def _(spark, d):
    return arrays.min_max(vector(spark, d))


@query("check_nan", "select false as has_nan")
def _(spark, d):
    return arrays.has_nan(vector(spark, d))


@query("point_shift", f"with {CLOUD} select node_id, cast(x::double + 1.5::double as float) as x, cast(y::double - 2::double as float) as y, cast(z::double + 0.25::double as float) as z from cl")
def _(spark, d):
    return arrays.shifted(cloud(spark, d), (1.5, -2.0, 0.25))


@query("point_scale", f"with {CLOUD} select node_id, cast(x::double * 2::double as float) as x, cast(y::double * 3::double as float) as y, cast(z::double * 0.5::double as float) as z from cl")
def _(spark, d):
    return arrays.scaled(cloud(spark, d), (2.0, 3.0, 0.5))


@query("point_rotate", f"with {CLOUD} select node_id, round(cos(0.5::double) * x::double - sin(0.5::double) * y::double, 4) + 0 as x, round(sin(0.5::double) * x::double + cos(0.5::double) * y::double, 4) + 0 as y from cl")
def _(spark, d):
    r = arrays.rotated2(_doubled(cloud(spark, d)), 0.5)
    return _rounded(r.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "x", "y", digits=4)


@query("squared_distance", f"with {CLOUD} select node_id, round((x::double - 0.1::double) ** 2 + (y::double - 0.2::double) ** 2 + (z::double - 0.3::double) ** 2, 6) as d2 from cl")
def _(spark, d):
    return arrays.squared_distance(_doubled(cloud(spark, d)), (0.1, 0.2, 0.3)).withColumn("d2", F.round("d2", 6))


@query("grid_slice", f"with {DIMS} select id % (n + 1) as iy, id // (n + 1) as iz, cast(cast(1 as double) * (id % (n + 1)) as float) as value from (select n, unnest(range((n + 1) * (n + 1))) as id from dims)")
def _(spark, d):
    n = cells(spark, d) + 1
    f = G.grid_field(G.regular_grid(spark, (n, n, n), (0.0, 0.0, 0.0, n - 1.0, n - 1.0, n - 1.0)), F.col("y"))
    return arrays.grid_slice(f, 1)


@query("grid_scale", f"with {DIMS} select id % (n + 1) as ix, (id // (n + 1)) % (n + 1) as iy, id // ((n + 1) * (n + 1)) as iz, 0 as comp, cast(2 * (id % (n + 1)) as float) as value from (select n, unnest(range((n + 1) * (n + 1) * (n + 1))) as id from dims)")
def _(spark, d):
    n = cells(spark, d) + 1
    return arrays.grid_scaled(G.grid_field(G.regular_grid(spark, (n, n, n), (0.0, 0.0, 0.0, n - 1.0, n - 1.0, n - 1.0)), F.col("x")), 2.0)


@query("mesh_function", f"with {DIMS}, {PTS} select node_id as id, round(x::double * y::double * z::double, 6) + 0 as value from pts")
def _(spark, d):
    f = F.col("x").cast("double") * F.col("y").cast("double") * F.col("z").cast("double")
    return _rounded(arrays.point_function(cube(spark, d).points, f), "value", digits=6)


@query("max_node_id", f"with {HEX}, {INC} select max(v) as max_node_id from inc")
def _(spark, d):
    return cube(spark, d).max_node_id()
