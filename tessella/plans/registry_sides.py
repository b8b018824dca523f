"""Registered queries of sides: boundaries by containment, side sets beside their parents, arrays that a description names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mesh import Block, Mesh
from ..operators import arrays, colocated, convert, sets
from ..sources import raw, sinks
from . import spelled
from .registry import HEX, SKIN, TET, TETPTS, cells, cube, query, sides_sql, table
from .registry_io import _folder

PARTS = 5


def _half_cut(spark, d) -> Mesh:
    """A cube whose cells beyond the middle of x are cut into tetrahedra, as a block of their own."""
    n, whole = cells(spark, d), cube(spark, d)
    beyond = F.col("elem_id") % n >= n // 2
    tets = convert.convert_to(Mesh(whole.points, whole.elements.where(beyond), whole.blocks), "TET4").elements
    rows = whole.elements.where(~beyond).unionByName(tets.withColumn("block_id", F.lit(1)))
    return Mesh(whole.points, rows, (Block(0, "whole", "HEX8"), Block(1, "cut", "TET4")))


def _literal(t) -> str:
    return str([list(x) for x in t])


HALF_CUT = (
    f"{HEX}, half as (select e, n, e % n >= n // 2 as beyond, nodes from el join dims on true), "
    f"tet as (select e * 6 + s as e, [nodes[k + 1] for k in {_literal(spelled.HEX8_TO_TET4)}[s + 1]] as nodes from (select *, unnest(range(6)) as s from half where beyond)), "
    "mixed as (select 0 as b, e, nodes from half where not beyond union all select 1, e, nodes from tet), "
    f"sd as (select b, e, s as lfi, [nodes[k + 1] for k in {_literal(spelled.SIDES['HEX8'])}[s + 1]] as side from (select *, unnest(range(6)) as s from mixed where b = 0) "
    f"union all select b, e, s, [nodes[k + 1] for k in {_literal(spelled.SIDES['TET4'])}[s + 1]] from (select *, unnest(range(4)) as s from mixed where b = 1))"
)


@query(
    "uncovered_sides",
    f"with {HALF_CUT}, held as (select b, e, nodes, unnest(nodes) as v from mixed) "
    "select e as parent, lfi, b as block_id from sd where not exists (select 1 from held h where h.v = sd.side[1] and (h.b <> sd.b or h.e <> sd.e) and list_has_all(h.nodes, sd.side))",
)
def _(spark, d):
    """Hexahedra beside tetrahedra: between them the triangles are inner and the quadrilaterals aren't."""
    return sets.uncovered_sides(_half_cut(spark, d)).select("parent", F.col("lfi").cast("int").alias("lfi"), "block_id")


RUNS = f"sz as (select n * n * n // {PARTS} as s, n * n * n % {PARTS} as m from dims), runs as (select p, p * s + least(p, m) as first, (p + 1) * s + least(p + 1, m) as stop from (select *, unnest(range({PARTS})) as p from sz))"


@query(
    "redistributed_sideset",
    f"with {HEX}, {sides_sql('HEX8')}, {SKIN}, {RUNS} select p::int as part, sk.e as parent, lfi, sk.e - first as local_parent, el.nodes from sk join el on el.e = sk.e join runs on sk.e >= first and sk.e < stop",
)
def _(spark, d):
    """A stored side set, read and dealt out over the parts of its parents."""
    mesh, at = cube(spark, d), _folder(spark, "sides")
    sinks.write_sideset(sets.skin_sideset(mesh), at, index="int64")
    out = colocated.redistributed(mesh, raw.read_sideset(spark, at), PARTS, buckets=8)
    return out.select("part", "parent", F.col("lfi").cast("int").alias("lfi"), "local_parent", "nodes")


def _described(spark, d) -> Mesh:
    """A stored mesh of tetrahedra whose arrays have names and types of their own, read by naming each of them."""
    mesh, at = cube(spark, d, "TET4"), _folder(spark, "described")
    names = {c: f"where/{c}_of_nodes.float64" for c in "xyz"}
    n_nodes = sinks.write_columns(mesh.points, {f"{at}/{f}": c for c, f in names.items()}, "node_id")
    corners = [f"topology/corner{k}.int64" for k in range(4)]
    n = sinks.write_columns(mesh.elements.select("elem_id", *[F.get("nodes", F.lit(k)).alias(f"n{k}") for k in range(4)]), {f"{at}/{f}": f"n{k}" for k, f in enumerate(corners)}, "elem_id")
    listed = {"points": [{c: f} for c, f in names.items()], "elements": [{f"i{k}": f} for k, f in enumerate(corners)]}
    return raw.mesh_from_description(spark, {"type": "file", "path": at, "spatial_dimension": 3, "n_nodes": n_nodes, "element_type": "TET4", "elem_num_nodes": 4, "n_elements": n} | listed)


@query("described_elements", f"with {TET} select e as elem_id, nodes from el")
def _(spark, d):
    return _described(spark, d).elements.select("elem_id", "nodes")


@query("described_points", f"with {TET}, {TETPTS} select node_id, x, y, z from pts")
def _(spark, d):
    return _described(spark, d).points


@query(
    "coarse_entries",
    "with half as (select count(*) // 2 as most from customer) select row_number() over (order by o_orderkey) - 1 as id, o_custkey as index, o_totalprice as value from orders, half where o_custkey <= most",
)
def _(spark, d):
    """The values of the orders whose customer is in the lower half."""
    most = table(spark, d, "customer").count() // 2
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("index"), F.col("o_totalprice").alias("value"))
    return arrays.coarse_entries(entries, most)
