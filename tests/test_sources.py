import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import sets
from tessella.sources import files, generate as G, raw, sinks


def _numbers(spark, n):
    return spark.range(n).select("id", (F.col("id") * 3).cast("double").alias("value"))


def _key(elements):
    return sorted((r.block_id, r.elem_id, tuple(r.nodes)) for r in elements.collect())


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "a.float64")
    sinks.write_array(_numbers(spark, 100), path)
    before = open(path, "rb").read()
    with pytest.raises(ValueError, match="ids have to be"):
        sinks.write_array(_numbers(spark, 100).where("id <> 50"), path)
    broken = _numbers(spark, 100).withColumn("value", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_array(broken, path)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["a.float64"]
    sinks.write_array(_numbers(spark, 10), path)
    assert os.path.getsize(path) == 80
    assert sinks.write_array(_numbers(spark, 0), path) == 0 and os.path.getsize(path) == 0


def test_id_bounds_reach_the_byte_ranges(spark, tmp_path):
    path = str(tmp_path / "a.float64")
    sinks.write_array(_numbers(spark, 1000), path)
    rows = raw.read_columns(spark, [path], split_bytes=800)
    assert rows.rdd.getNumPartitions() == 10
    part = rows.where("id between 250 and 449")
    assert part.rdd.getNumPartitions() == 2 and [r.c0 for r in part.orderBy("id").collect()] == [3.0 * i for i in range(250, 450)]
    assert rows.where("id = 7").collect()[0].c0 == 21.0 and rows.where("id = 7").rdd.getNumPartitions() == 1
    assert rows.where("id > 990 and c0 < 2980").count() == 3 and rows.where("id in (3, 905)").count() == 2
    assert rows.where("id > 5000").count() == 0 and rows.where("id < -1").count() == 0 and rows.where("id is null").count() == 0


def test_sessions_that_take_no_conditions_down(spark, tmp_path):
    """Spark's default: a reader with pushFilters is refused there."""
    path = str(tmp_path / "a.float64")
    sinks.write_array(_numbers(spark, 1000), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        rows = raw.read_columns(spark, [path], split_bytes=800)
        assert rows.count() == 1000 and [r.c0 for r in rows.where("id between 250 and 252").orderBy("id").collect()] == [750.0, 753.0, 756.0]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@pytest.mark.parametrize("n", [1, 60, 61])
def test_folders_in_a_store_that_only_spark_reads(spark, tmp_path, n):
    """A viewfs mount: no path of this machine."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own" + str(n) + ".link./in", f"file://{tmp_path}")
    m = G.hex8_cube(spark, n, 1, 1)
    sinks.write_mesh(m, str(tmp_path / "m"))
    sinks.write_sideset(sets.skin_sideset(m), str(tmp_path / "s"))
    there = raw.read_mesh(spark, f"viewfs://own{n}/in/m")
    assert _key(there.elements) == _key(m.elements) and sorted(map(tuple, there.points.collect())) == sorted(map(tuple, m.points.collect()))
    assert raw.read_sideset(spark, f"viewfs://own{n}/in/s").count() == 4 * n + 2
    assert raw.file_size(f"viewfs://own{n}/in/m/x.float32") == 16 * (n + 1) and files.names(f"viewfs://own{n}/in/none") == []
    with pytest.raises(ValueError, match="executors see"):
        sinks.write_mesh(m, f"viewfs://own{n}/in/other")


def test_record_rows():
    assert files.record_rows(60, 16) == 15 and files.record_rows(61, 16) == 1 and files.record_rows(5, 16) == 5


def test_cube_by_slabs(spark, tmp_path):
    sinks.write_hex8_cube(spark, str(tmp_path / "c"), 3, 2, 5, z_chunk=2)
    back, m = raw.read_mesh(spark, str(tmp_path / "c")), G.hex8_cube(spark, 3, 2, 5)
    assert _key(back.elements) == _key(m.elements) and sorted(map(tuple, back.points.collect())) == sorted(map(tuple, m.points.collect()))
    assert G.hex8_cube(spark, 3, 2, 5, slabs=3).elements.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("max_nodes", [40, 10_000])
def test_packed_folder(spark, tmp_path, max_nodes):
    m = G.hex8_cube(spark, 4, 3, 2)
    n = sinks.write_packed(m, str(tmp_path), max_nodes)
    assert (n > 1) == (max_nodes == 40) and os.path.getsize(tmp_path / "default" / "i0.int16") == 2 * 24
    back = raw.read_packed(spark, str(tmp_path))
    ids = {r.node_id: r.source_id for r in back.node_mapping.collect()}
    assert sorted(ids.values()) == list(range(60))
    assert [(b, e, tuple(ids[v] for v in nodes)) for b, e, nodes in _key(back.elements)] == _key(m.elements)
    at = {r.node_id: (r.x, r.y, r.z) for r in m.points.collect()}
    assert all((r.x, r.y, r.z) == at[ids[r.node_id]] for r in back.points.collect())


def test_fixed_size_blocks(spark, tmp_path):
    m = G.tet4_cube(spark, 2, 2, 2)
    assert sinks.write_blocks(m, str(tmp_path), 7) == 14
    assert _key(raw.read_blocks(spark, str(tmp_path))) == _key(m.elements)
    with pytest.raises(ValueError, match="16 bits"):
        sinks.write_blocks(G.hex8_cube(spark, 40, 40, 40), str(tmp_path / "b"), 1 << 20)
