"""The registered queries of the mesh engine and their SQL oracles.

Generated meshes grow with the data: a cube has floor(cbrt(rows of part)) cells along each axis, a square as many. The
other carriers are views of the tables: orders as elements of a hypergraph whose nodes are parts, embeddings as a point
cloud, parts as voxels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.elem_types import HEX8_SIDES, elem_types, side_tables
from ..mesh import Mesh
from ..operators import geometry, graph, sets
from ..sources import generate as G
from . import spelled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> int:
    return max(2, int(table(spark, sf_dir, "part").count() ** (1 / 3) + 1e-9))


def cube(spark: SparkSession, sf_dir: str, kind: str = "HEX8", n: int | None = None) -> Mesh:
    n = n or cells(spark, sf_dir)
    return G.cube(spark, kind, n, n, n)


def square(spark: SparkSession, sf_dir: str, kind: str) -> Mesh:
    n = cells(spark, sf_dir)
    return G.square(spark, kind, n, n)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x, y, z from the first three components of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), *[F.get("embedding", F.lit(k)).cast("float").alias(c) for k, c in enumerate("xyz")])


def hypergraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elem_id, node_id: distinct (order, part) pairs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem_id"), F.col("l_partkey").alias("node_id")).distinct()


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, value: retail price by part, ids from 0."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))


# SQL that both carriers share. One cell's corners are base + an offset for each.
DIMS = "dims as (select greatest(2, cast(floor(cbrt(count(*)) + 1e-9) as bigint)) as n from part)"
CELLS = f"{DIMS}, cells as (select e, n, e % n as cx, (e // n) % n as cy, e // (n * n) as cz, (n + 1) as w, (n + 1) * (n + 1) as h from (select n, unnest(range(n * n * n)) as e from dims)), based as (select *, cx + cy * w + cz * h as b from cells)"
HEX = f"{CELLS}, el as (select e, [b, b + 1, b + w + 1, b + w, b + h, b + h + 1, b + h + w + 1, b + h + w] as nodes from based)"
PTS = "pts as (select id as node_id, cast(0.0 + (id % (n + 1)) * (1.0 / n) as float) as x, cast(0.0 + ((id // (n + 1)) % (n + 1)) * (1.0 / n) as float) as y, cast(0.0 + (id // ((n + 1) * (n + 1))) * (1.0 / n) as float) as z from (select n, unnest(range((n + 1) * (n + 1) * (n + 1))) as id from dims))"
FACES = str([list(f) for f in spelled.CELL_FACES])
TET = f"""{CELLS}, corner as (select e, n, [b, b + 1, b + w + 1, b + w, b + h, b + h + 1, b + h + w + 1, b + h + w] as v, e + w * h as c from based),
el as (select e * 12 + s as e, [v[f[1] + 1], v[f[2 + s % 2] + 1], v[f[3 + s % 2] + 1], c] as nodes from (select *, {FACES}[s // 2 + 1] as f from (select *, unnest(range(12)) as s from corner)))"""
TETPTS = PTS.replace("pts as", "grid as") + ", pts as (select * from grid union all select e + w * h, cast((cx + 0.5) * (1.0 / n) as float), cast((cy + 0.5) * (1.0 / n) as float), cast((cz + 0.5) * (1.0 / n) as float) from cells)"
FLAT = f"{DIMS}, flat as (select e, n, e % n + (e // n) * (n + 1) as b, n + 1 as w from (select n, unnest(range(n * n)) as e from dims))"
TRI = f"{FLAT}, el as (select e * 2 + s as e, case s when 0 then [b, b + 1, b + w] else [b + 1, b + w + 1, b + w] end as nodes from (select *, unnest(range(2)) as s from flat))"
QUAD = f"{FLAT}, el as (select e, [b, b + 1, b + w + 1, b + w] as nodes from flat)"
FLATPTS = "pts as (select id as node_id, cast(0.0 + (id % (n + 1)) * (1.0 / n) as float) as x, cast(0.0 + (id // (n + 1)) * (1.0 / n) as float) as y from (select n, unnest(range((n + 1) * (n + 1))) as id from dims))"
INC = "inc as (select e, unnest(nodes) as v from el)"
CLOUD = "cl as (select vec_id as node_id, embedding[1] as x, embedding[2] as y, embedding[3] as z from embeddings)"


def sides_sql(kind: str) -> str:
    """si(e, lfi, nodes, key) from el."""
    t = str([list(s) for s in spelled.SIDES[kind]])
    n = len(spelled.SIDES[kind])
    return f"si as (select e, s as lfi, [nodes[k + 1] for k in {t}[s + 1]] as nodes, list_sort([nodes[k + 1] for k in {t}[s + 1]]) as key from (select *, unnest(range({n})) as s from el))"


def sub_sql(pattern: tuple[tuple[int, ...], ...], at: str = "el") -> str:
    """Rows (e * n + s, nodes) of every element under a pattern."""
    p = str([list(x) for x in pattern])
    return f"select e * {len(pattern)} + s as e, [nodes[k + 1] for k in {p}[s + 1]] as nodes from (select *, unnest(range({len(pattern)})) as s from {at})"


# --- generated sources -------------------------------------------------------------------------------------------------


@query("gen_hex8_cube", f"with {HEX} select 0 as block_id, e as elem_id, nodes from el")
def _(spark, d):
    return cube(spark, d).elements


@query("gen_hex8_points", f"with {DIMS}, {PTS} select * from pts")
def _(spark, d):
    return cube(spark, d).points


@query("table_hex8_cube", f"with {HEX} select e as elem_id, nodes from el")
def _(spark, d):
    """The generator as a table function of SQL."""
    tables.register(spark)
    n = cells(spark, d)
    return spark.sql(f"select c.* from range({n}) layers, lateral hex8_layer(layers.id, {n}, {n}) c")


@query("table_hex8_points", f"with {DIMS}, {PTS} select * from pts")
def _(spark, d):
    tables.register(spark)
    n = cells(spark, d)
    return spark.sql(f"select p.* from range({n + 1}) layers, lateral hex8_layer_points(layers.id, {n}, {n}, {n}) p")


@query("gen_hex8_reference_cube", "select 0 as block_id, 0 as elem_id, [0, 1, 3, 2, 4, 5, 7, 6] as nodes")
def _(spark, d):
    return G.hex8_reference_cube(spark).elements


@query("gen_tet4_cube", f"with {TET} select 0 as block_id, e as elem_id, nodes from el")
def _(spark, d):
    return cube(spark, d, "TET4").elements


@query("gen_tet4_points", f"with {CELLS}, {TETPTS} select * from pts")
def _(spark, d):
    return cube(spark, d, "TET4").points


@query("gen_tri3_square", f"with {TRI} select 0 as block_id, e as elem_id, nodes from el")
def _(spark, d):
    return square(spark, d, "TRI3").elements


@query("gen_quad4_square", f"with {QUAD} select 0 as block_id, e as elem_id, nodes from el")
def _(spark, d):
    return square(spark, d, "QUAD4").elements


@query("gen_square_points", f"with {DIMS}, {FLATPTS} select *, cast(null as float) as z from pts")
def _(spark, d):
    return square(spark, d, "QUAD4").points


@query("gen_quad4_ring", f"with {DIMS}, c as (select n, e, e // n as l, e % n as i from (select n, unnest(range(n * n)) as e from dims)) select 0 as block_id, e as elem_id, [l * n + (i + 1) % n, l * n + i, l * n + i + n, l * n + (i + 1) % n + n] as nodes from c")
def _(spark, d):
    n = cells(spark, d)
    return G.quad4_ring(spark, 0.5, 1.0, n, n).elements


@query("gen_ring_points", f"with {DIMS}, c as (select n, id, id // n as l, id % n as i from (select n, unnest(range(n * (n + 1))) as id from dims)) select id as node_id, round(cast(cos(2 * pi() / n * i) * (0.5 + 0.5 / n * l) as float), 5) + 0::float as x, round(cast(sin(2 * pi() / n * i) * (0.5 + 0.5 / n * l) as float), 5) + 0::float as y from c")
def _(spark, d):
    n = cells(spark, d)
    return _rounded(G.quad4_ring(spark, 0.5, 1.0, n, n).points.drop("z"), "x", "y")


def _rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    # Adding zero turns -0.0, which prints unlike 0.0, into 0.0.
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0).cast(df.schema[c].dataType) for c in names})


BALL = """ball as (select node_id, x, y, z, greatest(abs(x), abs(y), z) as m from pt), unit as (select *, x / m as a, y / m as b, z / m as c from ball)
select node_id, round(case when m > 0 then m * a * sqrt(1 - (b*b + c*c) * 0.5 + b*b*c*c / 3) else 0 end, 4) + 0 as x, round(case when m > 0 then m * b * sqrt(1 - (a*a + c*c) * 0.5 + a*a*c*c / 3) else 0 end, 4) + 0 as y, round(case when m > 0 then m * c * sqrt(1 - (a*a + b*b) * 0.5 + a*a*b*b / 3) else 0 end, 4) + 0 as z from unit"""


@query("gen_hex8_half_sphere", f"with {DIMS}, pt as (select id as node_id, 2.0::double * (id % (n + 1)) / n - 1 as x, 2.0::double * ((id // (n + 1)) % (n + 1)) / n - 1 as y, 1.0::double * (id // ((n + 1) * (n + 1))) / n as z from (select n, unnest(range((n + 1) * (n + 1) * (n + 1))) as id from dims)), {BALL}")
def _(spark, d):
    n = cells(spark, d)
    p = G.half_sphere(spark, "HEX8", 1.0, n, n, n).points
    return _rounded(p.select("node_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), "x", "y", "z", digits=4)


@query("gen_tet4_half_sphere_counts", f"with {DIMS} select 24 * n * n * n as n_elements, (n + 1) * (n + 1) * (n + 1) + 3 * (n + 1) * n * n + n * n * n as n_nodes, 24 * n * n * n as n_positive from dims")
def _(spark, d):
    n = cells(spark, d)
    m = G.half_sphere(spark, "TET4", 1.0, n, n, n)
    v = geometry.volumes(m).agg(F.count("*").alias("n_elements"), F.sum((F.abs("volume") > 0).cast("long")).alias("n_positive"))
    return v.crossJoin(m.points.agg(F.count("*").alias("n_nodes")))


@query("gen_bidomain_cube", f"with {HEX}, s as (select el.e, nodes, cx, cy, cz, n, n // 2 as k from el join cells on cells.e = el.e) select case when cx < k then 0 else 1 end as block_id, case when cx < k then cx + k * (cy + n * cz) else cx - k + (n - k) * (cy + n * cz) end as elem_id, nodes from s")
def _(spark, d):
    n = cells(spark, d)
    return G.hex8_bidomain_cube(spark, n, n, n, 0, n // 2).elements


@query("gen_checkerboard_cube", """with cells as (select e, e % 4 as cx, (e // 4) % 4 as cy, e // 16 as cz from (select unnest(range(64)) as e)), b as (select *, cx + cy * 5 + cz * 25 as b from cells)
select (cx + cy + cz) % 2 as block_id, row_number() over (partition by (cx + cy + cz) % 2 order by e) - 1 as elem_id, [b, b + 1, b + 6, b + 5, b + 25, b + 26, b + 31, b + 30] as nodes from b""")
def _(spark, d):
    return G.hex8_checkerboard_cube(spark, 4, 4, 4).elements


@query("gen_wall_mounted_hump", f"with {DIMS}, {PTS}, s as (select node_id, x, y, z, (x::double - 0.25::double) / 0.5::double as t from pts), f as (select *, case when x between 0.25 and 0.75 then 0.1::double * sin(pi() * t) * sin(pi() * t) else 0 end as b from s) select node_id, x, round(cast(cast(b + y::double * (1.0::double - b) as float) as double), 6) + 0 as y, z from f")
def _(spark, d):
    n = cells(spark, d)
    p = G.wall_mounted_hump(spark, "HEX8", n, n, n, 1.0, 1.0, 1.0, 0.25, 0.5, 0.1).points
    return _rounded(p.withColumn("y", F.col("y").cast("double")), "y", digits=6)


@query("gen_hex27_cube_counts", f"with {DIMS} select n * n * n as n_elements, (2 * n + 1) * (2 * n + 1) * (2 * n + 1) as n_nodes, n * n * n * 27 as n_incidences from dims")
def _(spark, d):
    m = cube(spark, d, "HEX27")
    return m.incidence().agg(F.count_distinct("elem_id").alias("n_elements"), F.count_distinct("node_id").alias("n_nodes"), F.count("*").alias("n_incidences"))


@query("gen_label_mesh", """with vox as (select p_partkey as id, p_size % 2 as label from part), a as (select id % 20 as cx, (id // 20) % 20 as cy, id // 400 as cz from vox where label = 1),
e as (select row_number() over (order by cz, cy, cx) - 1 as e, cx + cy * 21 + cz * 441 as b from a), el as (select e, [b, b + 1, b + 22, b + 21, b + 441, b + 442, b + 463, b + 462] as nodes from e),
inc as (select e, k, nodes[k + 1] as v from (select *, unnest(range(8)) as k from el)), f as (select v, row_number() over (order by m) - 1 as nid from (select v, min((e, k)) as m from inc group by v)) select 0 as block_id, e as elem_id, list(nid order by k) as nodes from inc join f using (v) group by e""")
def _(spark, d):
    i = F.col("p_partkey")
    vox = table(spark, d, "part").select((i % 20).alias("ix"), (F.floor(i / 20) % 20).alias("iy"), F.floor(i / 400).alias("iz"), (F.col("p_size") % 2).alias("label"))
    return G.mesh_of_labels(vox, 20, 20, 1).elements


@query("grid_create", f"with {DIMS} select id % (n + 1) as ix, (id // (n + 1)) % (n + 1) as iy, id // ((n + 1) * (n + 1)) as iz, 0 as comp, cast(round(sqrt((((id % (n + 1)) * (1.0::double / n)) - 0.5) ** 2 + ((((id // (n + 1)) % (n + 1)) * (1.0::double / n)) - 0.5) ** 2 + (((id // ((n + 1) * (n + 1))) * (1.0::double / n)) - 0.5) ** 2) - 0.25, 4) as double) + 0 as value from (select n, unnest(range((n + 1) * (n + 1) * (n + 1))) as id from dims)")
def _(spark, d):
    n = cells(spark, d) + 1
    r = sum(((F.col(c) - 0.5) * (F.col(c) - 0.5) for c in "xyz"), F.lit(0.0))
    f = G.grid_field(G.regular_grid(spark, (n, n, n)), F.sqrt(r) - 0.25)
    return _rounded(f.withColumn("value", F.col("value").cast("double")), "value", digits=4)


# --- element types -----------------------------------------------------------------------------------------------------


@query("elem_types")
def _(spark, d):
    return elem_types(spark)


@query("side_tables", "select elem_type, lfi, k, lnode from (values " + ", ".join(f"('{n}', {s}, {k}, {v})" for n, t in spelled.SIDES.items() for s, side in enumerate(t) for k, v in enumerate(side)) + ") t(elem_type, lfi, k, lnode)")
def _(spark, d):
    return side_tables(spark)


@query("hex8_side_names", "select * from (values " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(spelled.HEX8_SIDE_NAMES)) + ") t(lfi, name)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(HEX8_SIDES)), "lfi int, name string")


# --- graphs ------------------------------------------------------------------------------------------------------------


@query("n2e_hypergraph", "select l_partkey as node_id, list(distinct l_orderkey order by l_orderkey) as elems from lineitem group by 1")
def _(spark, d):
    return hypergraph(spark, d).groupBy("node_id").agg(F.sort_array(F.collect_list("elem_id")).alias("elems"))


@query("n2e", f"with {HEX}, {INC} select v as node_id, 0 as block_id, e as elem_id from inc")
def _(spark, d):
    return graph.node_to_element(cube(spark, d))


@query("n2e_lists", f"with {TET}, {INC} select v as node_id, list(e order by e) as elems from inc group by v")
def _(spark, d):
    return graph.node_to_element_lists(cube(spark, d, "TET4")).select("node_id", F.transform("elems", lambda s: s["elem_id"]).alias("elems"))


@query("n2n_hypergraph", "with h as (select distinct l_orderkey as e, l_partkey as v from lineitem) select distinct a.v as i, b.v as j from h a join h b using (e)")
def _(spark, d):
    h = hypergraph(spark, d).groupBy("elem_id").agg(F.collect_list("node_id").alias("nodes"))
    return h.select("nodes", F.explode("nodes").alias("i")).select("i", F.explode("nodes").alias("j")).distinct()


@query("n2n", f"with {HEX}, {INC} select distinct a.v as i, b.v as j from inc a join inc b using (e)")
def _(spark, d):
    return graph.node_to_node(cube(spark, d))


@query("n2n_multiblock", f"with {HEX}, {INC} select distinct a.v as i, b.v as j from inc a join inc b using (e)")
def _(spark, d):
    n = cells(spark, d)
    return graph.node_to_node(G.hex8_bidomain_cube(spark, n, n, n, 2, 1))


@query("n2n_upper", f"with {TET}, {INC} select distinct a.v as i, b.v as j from inc a join inc b using (e) where b.v > a.v")
def _(spark, d):
    return graph.upper_triangular(cube(spark, d, "TET4"))


def edges_sql(kind: str) -> str:
    return f"select distinct least(nodes[1], nodes[2]) as i, greatest(nodes[1], nodes[2]) as j from ({sub_sql(spelled.EDGES[kind])})"


@query("edges_quad4", f"with {QUAD} {edges_sql('QUAD4')}")
def _(spark, d):
    return graph.edges(square(spark, d, "QUAD4"))


@query("edges_hex8_both_ways", f"with {HEX}, x as ({edges_sql('HEX8')}) select i, j from x union all select j, i from x")
def _(spark, d):
    return graph.edges_both_ways(cube(spark, d))


@query("dual_hypergraph", "with h as (select distinct l_orderkey as e, l_partkey as v from lineitem) select a.e as e1, b.e as e2, count(*) as shared from h a join h b using (v) where a.e < b.e group by 1, 2 having count(*) >= 2")
def _(spark, d):
    return graph.sharing_two(hypergraph(spark, d))


@query("dual", f"with {TET}, {INC} select a.e as e1, b.e as e2 from inc a join inc b using (v) where a.e <> b.e group by 1, 2 having count(*) = 3")
def _(spark, d):
    return graph.dual(cube(spark, d, "TET4")).select("e1", "e2")


@query("dual_multiblock", f"with {HEX}, {INC}, s as (select cells.e, case when cz < 1 then 0 else 1 end as blk, case when cz < 1 then cells.e else cells.e - n * n end as le from cells), p as (select a.e as e1, b.e as e2 from inc a join inc b using (v) where a.e <> b.e group by 1, 2 having count(*) = 4) select x.blk as block1, x.le as e1, y.blk as block2, y.le as e2 from p join s x on x.e = p.e1 join s y on y.e = p.e2")
def _(spark, d):
    n = cells(spark, d)
    return graph.dual(G.hex8_bidomain_cube(spark, n, n, n, 2, 1))


@query("half_faces", f"with {HEX}, {sides_sql('HEX8')} select a.e as elem_id, a.lfi, b.e as neigh from si a left join si b on a.key = b.key and a.e <> b.e")
def _(spark, d):
    return graph.half_faces(cube(spark, d)).select("elem_id", F.col("lfi").cast("int").alias("lfi"), "neigh")


@query("block_to_scalar", f"with {TRI}, {INC}, g as (select distinct a.v as i, b.v as j from inc a join inc b using (e)) select i * 2 + r as i, j * 2 + c as j, cast(i + 10 * (c * 2 + r) as double) as value from g, (select unnest(range(2)) as r), (select unnest(range(2)) as c)")
def _(spark, d):
    g = graph.node_to_node(square(spark, d, "TRI3"))
    vals = F.array(*[(F.col("i") + 10 * k).cast("double") for k in range(4)])
    return graph.block_to_scalar(g.withColumn("vals", vals), 2, "vals")


@query("row_pointers", f"with {TRI}, {INC}, g as (select distinct a.v as i, b.v as j from inc a join inc b using (e)), r as (select unnest(range((n + 1) * (n + 1) + 1)) as row from dims) select row, (select count(*) from g where i < row) as start from r")
def _(spark, d):
    n = cells(spark, d)
    return graph.row_pointers(graph.node_to_node(square(spark, d, "TRI3")), (n + 1) ** 2)


@query("crs_round_trip", f"with {TRI}, {INC} select distinct a.v as i, b.v as j from inc a join inc b using (e)")
def _(spark, d):
    from ..operators.numbering import dense_ids

    g = graph.node_to_node(square(spark, d, "TRI3"))
    n = cells(spark, d)
    return graph.from_row_pointers(graph.row_pointers(g, (n + 1) ** 2), dense_ids(g, ["i", "j"], "k").select("k", "j"))


@query("eccentricity", f"with {TET}, {INC} select a.v as i, max(abs(b.v - a.v)) as eccentricity from inc a join inc b using (e) group by 1")
def _(spark, d):
    return graph.eccentricity(graph.node_to_node(cube(spark, d, "TET4")))


ADJ = f"{TRI}, {INC}, g as (select distinct a.v as i, b.v as j from inc a join inc b using (e))"


@query("adjacency_default", f"with {ADJ} select i, j, case when i = j then 0.0::double else 1.0::double end as value from g")
def _(spark, d):
    return graph.adjacency_matrix(graph.node_to_node(square(spark, d, "TRI3")))


@query("adjacency_laplacian", f"with {ADJ} select i, j, case when i = j then 1.0::double - count(*) over (partition by i) else 1.0::double end as value from g")
def _(spark, d):
    return graph.adjacency_matrix(graph.node_to_node(square(spark, d, "TRI3")), laplacian=True)


@query("adjacency_normalized", f"with {ADJ} select i, j, round(case when i = j then 0.0::double else 1.0::double / (count(*) over (partition by i) - 1) end, 9) as value from g")
def _(spark, d):
    return _rounded(graph.adjacency_matrix(graph.node_to_node(square(spark, d, "TRI3")), normalize_rows=True), "value", digits=9)


@query("adjacency_directed", f"with {ADJ} select i, j, case when j < i then 1.0::double else 0.0::double end as value from g")
def _(spark, d):
    return graph.adjacency_matrix(graph.node_to_node(square(spark, d, "TRI3")), directed=True)


@query("adjacency_lower", f"with {ADJ} select i, j, case when i = j then 0.0::double when j < i then -1.0::double else 1.0::double end as value from g")
def _(spark, d):
    return graph.adjacency_matrix(graph.node_to_node(square(spark, d, "TRI3")), negate_lower=True)


@query("condense_matrix", f"with {ADJ}, keep as (select id, row_number() over (order by id) - 1 as k from (select unnest(range((n + 1) * (n + 1))) as id from dims) where id % 3 <> 0) select a.k as i, b.k as j, 1.0::double as value from g join keep a on a.id = g.i join keep b on b.id = g.j")
def _(spark, d):
    n = cells(spark, d)
    g = graph.node_to_node(square(spark, d, "TRI3")).withColumn("value", F.lit(1.0))
    return graph.condensed_matrix(g, (n + 1) ** 2, spark.range(0, (n + 1) ** 2, 3))


@query("incidence_counts_lineitem", "select l_partkey as node_id, count(*) as n from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("n"))


@query("incidence_counts", f"with {TET}, {INC} select v as node_id, count(*) as n from inc group by v")
def _(spark, d):
    return graph.incidence_counts(cube(spark, d, "TET4"))


# --- boundary and sets -------------------------------------------------------------------------------------------------

SKIN = "sk as (select min(e) as e, min(lfi) as lfi, any_value(nodes) as nodes from si group by key having count(*) = 1)"


@query("skin_hex8", f"with {HEX}, {sides_sql('HEX8')}, {SKIN} select e as parent, lfi, nodes from sk")
def _(spark, d):
    return sets.boundary(cube(spark, d)).select("parent", F.col("lfi").cast("int").alias("lfi"), "nodes")


@query("skin_tet4", f"with {TET}, {sides_sql('TET4')}, {SKIN} select e as parent, lfi from sk")
def _(spark, d):
    return sets.skin_sideset(cube(spark, d, "TET4")).select("parent", F.col("lfi").cast("int").alias("lfi"))


@query("skin_nodeset", f"with {HEX}, {sides_sql('HEX8')}, {SKIN} select distinct unnest(nodes) as node_id from sk")
def _(spark, d):
    m = cube(spark, d)
    return sets.nodeset(m, sets.skin_sideset(m))


@query("skin_mesh", f"with {HEX}, {sides_sql('HEX8')}, {SKIN}, o as (select row_number() over (order by e, lfi) - 1 as s, nodes from sk), i as (select s, k, nodes[k + 1] as v from (select *, unnest(range(4)) as k from o)), f as (select v, row_number() over (order by m) - 1 as nid from (select v, min((s, k)) as m from i group by v)) select s as elem_id, list(nid order by k) as nodes from i join f using (v) group by s")
def _(spark, d):
    return sets.skin(cube(spark, d)).elements.select("elem_id", "nodes")


@query("sideset_on_plane", f"with {HEX}, {PTS}, {sides_sql('HEX8')}, c as (select e, lfi, avg(x) as x from (select e, lfi, unnest(nodes) as node_id from si) join pts using (node_id) group by 1, 2) select e as parent, lfi from c where abs(x) < 1e-8")
def _(spark, d):
    return sets.sideset_on_plane(cube(spark, d), (1.0, 0.0, 0.0), 0.0).select("parent", F.col("lfi").cast("int").alias("lfi"))


@query("sideset_selector", f"with {HEX}, {PTS}, {sides_sql('HEX8')}, c as (select e, lfi, avg(x::double) as x, avg(y::double) as y, avg(z::double) as z from (select e, lfi, unnest(nodes) as node_id from si) join pts using (node_id) group by 1, 2) select e as parent, lfi from c where x + y < 0.45 and z > 0.55")
def _(spark, d):
    return sets.sideset_where(cube(spark, d), (F.col("x") + F.col("y") < 0.45) & (F.col("z") > 0.55)).select("parent", F.col("lfi").cast("int").alias("lfi"))


@query("sideset_batch_selector", f"with {HEX}, {PTS}, {sides_sql('HEX8')}, c as (select e, lfi, avg(x::double) as x, avg(y::double) as y, avg(z::double) as z from (select e, lfi, unnest(nodes) as node_id from si) join pts using (node_id) group by 1, 2) select e as parent, lfi from c where x + y < 0.45 and z > 0.55")
def _(spark, d):
    @F.pandas_udf("boolean")
    def inside(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return (x + y < 0.45) & (z > 0.55)

    return sets.sideset_where(cube(spark, d), inside("x", "y", "z")).select("parent", F.col("lfi").cast("int").alias("lfi"))


@query("sides_by_parent", f"with {HEX}, {sides_sql('HEX8')}, {SKIN} select e as parent, count(*) as n, list(lfi order by lfi) as sides from sk group by e")
def _(spark, d):
    return sets.sides_by_parent(sets.skin_sideset(cube(spark, d))).select("parent", "n", F.col("sides").cast("array<int>").alias("sides"))


@query("select_elements", f"with {HEX}, {PTS}, c as (select e, avg(x::double) as x, avg(z::double) as z from (select e, unnest(nodes) as node_id from el) join pts using (node_id) group by e) select e as elem_id from c where x * x + z * z < 0.3")
def _(spark, d):
    return sets.select_elements(cube(spark, d), F.col("x") * F.col("x") + F.col("z") * F.col("z") < 0.3).select("elem_id")


@query("select_submesh", f"with {HEX}, ch as (select e as pos, (e * 7) % (n * n * n) as e from cells where e % 5 = 0), o as (select row_number() over (order by pos) - 1 as s, nodes from ch join el using (e)), i as (select s, k, nodes[k + 1] as v from (select *, unnest(range(8)) as k from o)), f as (select v, row_number() over (order by m) - 1 as nid from (select v, min((s, k)) as m from i group by v)) select s as elem_id, list(nid order by k) as nodes from i join f using (v) group by s")
def _(spark, d):
    m = cube(spark, d)
    n = cells(spark, d)
    ids = spark.range(0, n**3, 5).select(F.col("id").alias("pos"), F.lit(0).alias("block_id"), (F.col("id") * 7 % n**3).alias("elem_id"))
    return sets.select_submesh(m, ids).elements.select("elem_id", "nodes")


@query("split_boundary_layer", f"with {HEX}, {sides_sql('HEX8')}, {SKIN}, p as (select distinct e from sk), a as (select 0 as block_id, row_number() over (order by e) - 1 as elem_id, nodes from el semi join p using (e)), b as (select 1 as block_id, row_number() over (order by e) - 1 as elem_id, nodes from el anti join p using (e)) select * from a union all select * from b")
def _(spark, d):
    return sets.split_boundary_layer(cube(spark, d)).elements


@query("renumber_nodes", f"with {TET}, i as (select e, k, nodes[k + 1] as v from (select *, unnest(range(4)) as k from el)), f as (select v, row_number() over (order by m) - 1 as nid from (select v, min((e, k)) as m from i group by v)) select e as elem_id, list(nid order by k) as nodes from i join f using (v) group by e")
def _(spark, d):
    return sets.renumber_nodes(cube(spark, d, "TET4")).elements.select("elem_id", "nodes")


@query("reorder_by_tags", "select o_orderkey as old_id, row_number() over (order by o_orderstatus, o_orderkey) - 1 as new_id from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    tags = o.select(F.col("o_orderkey").alias("elem_id"), F.col("o_orderstatus").alias("tag"))
    return sets.reorder_by_tags(o.select(F.col("o_orderkey").alias("elem_id")), tags)


@query("surface_is_closed", "select * from (values ('square', false), ('skin', true)) t(name, is_closed)")
def _(spark, d):
    a = sets.surface_is_closed(square(spark, d, "TRI3")).select(F.lit("square").alias("name"), "is_closed")
    return a.unionByName(sets.surface_is_closed(sets.skin(cube(spark, d, n=3))).select(F.lit("skin").alias("name"), "is_closed"))


@query("sharp_edges", f"with {DIMS} select 12 * n as n_edges, cast(8 as bigint) as n_corners, 6 * (n - 2) * (n - 2) as n_faces from dims")
def _(spark, d):
    from ..storage import materialize

    s = sets.skin(cube(spark, d))
    s = replace(s, elements=materialize(s.elements), points=materialize(s.points))
    sharp = materialize(sets.sharp_edges(s))
    a, b, c = sharp.agg(F.count("*").alias("n_edges")), sets.sharp_corners(sharp).agg(F.count("*").alias("n_corners")), sets.disconnected_faces(s, sharp).agg(F.count("*").alias("n_faces"))
    return a.crossJoin(b).crossJoin(c)  # three rows of one


@query("sideset_from_seed", f"with {DIMS} select (n * n * n - n * n + id) as parent, 5 as lfi from (select n, unnest(range(n * n)) as id from dims)")
def _(spark, d):
    return sets.sideset_from_seed(cube(spark, d), (0.5, 0.5, 1.0), 0.9).select("parent", F.col("lfi").cast("int").alias("lfi"))


@query("nearest_elements", f"with {HEX}, {PTS}, c as (select e, avg(x::double) as x, avg(y::double) as y, avg(z::double) as z from (select e, unnest(nodes) as node_id from el) join pts using (node_id) group by e) select e as elem_id from c order by (x - 0.11) ** 2 + (y - 0.23) ** 2 + (z - 0.37) ** 2, e limit 10")
def _(spark, d):
    return sets.nearest_elements(cube(spark, d), (0.11, 0.23, 0.37), 10).select("elem_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import registry_io, registry_lattice, registry_more, registry_sides  # noqa: E402,F401  the other queries
