"""Registered queries of the readers and writers: what is written to the shared folder and read back, against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import sets
from ..sources import files, raw, sinks
from ..storage import shared_dir
from .registry import DIMS, HEX, PTS, TET, cells, cube, query, table


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the materialised tables, as the path that executors see."""
    return files.local(f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}")


@query("write_read_elements", f"with {TET} select 0 as block_id, e as elem_id, nodes from el")
def _(spark, d):
    at = _folder(spark, "mesh")
    sinks.write_mesh(cube(spark, d, "TET4"), at, index="int64")
    return raw.read_mesh(spark, at).elements


@query("write_read_points", f"with {DIMS}, {PTS} select * from pts")
def _(spark, d):
    at, n = _folder(spark, "cube"), cells(spark, d)
    sinks.write_hex8_cube(spark, at, n, n, n, z_chunk=4)
    return raw.read_points(spark, at)[0]


@query("write_read_slabs", f"with {HEX} select e as elem_id, nodes from el")
def _(spark, d):
    at, n = _folder(spark, "cube"), cells(spark, d)
    sinks.write_hex8_cube(spark, at, n, n, n, z_chunk=4)
    return raw.read_block(spark, at)


@query(
    "write_read_sideset",
    f"with {HEX}, sd as (select e, unnest(range(6)) as lfi, unnest([[0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7], [3, 2, 1, 0], [4, 5, 6, 7]]) as f, nodes from el), "
    "k as (select e, lfi, list_sort([nodes[i + 1] for i in f]) as key from sd) select any_value(e) as parent, any_value(lfi)::int as lfi from k group by key having count(*) = 1",
)
def _(spark, d):
    at = _folder(spark, "sides")
    sinks.write_sideset(sets.skin_sideset(cube(spark, d)), at, index="int64")
    return raw.read_sideset(spark, at).select("parent", F.col("lfi").cast("int").alias("lfi"))


@query("write_read_packed", f"with {HEX} select e as elem_id, nodes from el")
def _(spark, d):
    """Through packs of at most 500 nodes and their local ids, led back to the nodes' own ids."""
    at = _folder(spark, "packed")
    sinks.write_packed(cube(spark, d), at, 500)
    back = raw.read_packed(spark, at)
    long = back.incidence().join(back.node_mapping, "node_id")
    by = long.groupBy("elem_id").agg(F.sort_array(F.collect_list(F.struct("lnode", "source_id"))).alias("x"))
    return by.select("elem_id", F.transform("x", lambda s: s["source_id"]).alias("nodes"))


@query("write_read_blocks", f"with {TET} select e as elem_id, nodes from el")
def _(spark, d):
    at = _folder(spark, "blocks")
    sinks.write_blocks(cube(spark, d, "TET4"), at, 1000)
    return raw.read_blocks(spark, at).select("elem_id", "nodes")


_ORDERS = "o as (select row_number() over (order by o_orderkey) - 1 as id, o_totalprice as value from orders)"


def _prices(spark, d):
    """id from 0 in the order of o_orderkey, value."""
    from ..operators.numbering import dense_ids

    return dense_ids(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), ["o_orderkey"], "id").select("id", "value")


@query("write_read_array", f"with {_ORDERS} select id, value::float::double as value from o")
def _(spark, d):
    at = _folder(spark, "array")
    sinks.write_array(_prices(spark, d), f"{at}/price.float32")
    return raw.read_array(spark, f"{at}/price.float32", as_type="double")


@query("read_array_range", f"with {_ORDERS}, n as (select count(*) as n from o) select id, value from o, n where id >= n // 4 and id < n // 2")
def _(spark, d):
    """A run of ids: the bounds reach the byte ranges that are read."""
    at = _folder(spark, "array")
    n = sinks.write_array(_prices(spark, d), f"{at}/price.float64")
    return raw.read_array(spark, f"{at}/price.float64").where((F.col("id") >= n // 4) & (F.col("id") < n // 2))


@query("read_mapped_field", f"with {_ORDERS}, n as (select count(*) as n from o) select a.id, b.value from o a, n join o b on b.id = n - 1 - a.id")
def _(spark, d):
    """A stored field through a mapping: the order of prices turned around."""
    at = _folder(spark, "array")
    n = sinks.write_array(_prices(spark, d), f"{at}/price.float64")
    mapping = spark.range(n).select("id", (n - 1 - F.col("id")).alias("source"))
    return raw.read_mapped_field(spark, f"{at}/price.float64", mapping)


@query("write_read_grid", f"with {DIMS}, g as (select n + 1 as w, unnest(range((n + 1) * (n + 1) * (n + 1))) as i from dims) select i % w as ix, (i // w) % w as iy, i // (w * w) as iz, 0 as comp, ((i % w) * 3 + ((i // w) % w) * 5 - i // (w * w) + 1)::double * 2 as value from g")
def _(spark, d):
    from ..sources import generate as G

    w, at = cells(spark, d) + 1, _folder(spark, "grid")
    grid = G.regular_grid(spark, (w, w, w)).select("ix", "iy", "iz", F.lit(0).alias("comp"), (F.col("ix") * 3 + F.col("iy") * 5 - F.col("iz")).cast("float").alias("value"))
    sinks.write_grid(grid, at, (w, w, w), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    return raw.read_grid(spark, at, shift=1.0, scale=2.0)[0].withColumn("value", F.col("value").cast("double"))
