"""Array operators over (id, value) tables: masks, gathers, set operations, condensation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import dense_ids


def mask(spark: SparkSession, n: int, ids: DataFrame) -> DataFrame:
    """id, on: whether an index is listed."""
    listed = ids.select("id").distinct().withColumn("on", F.lit(True))
    return spark.range(n).join(listed, "id", "left").select("id", F.coalesce("on", F.lit(False)).alias("on"))


def mask_bytes(flags: DataFrame) -> DataFrame:
    """byte, value: eight flags a byte, lowest bit first."""
    bit = F.when(F.col("on"), F.call_function("shiftleft", F.lit(1), (F.col("id") % 8).cast("int"))).otherwise(0)
    return flags.groupBy(F.call_function("div", F.col("id"), F.lit(8)).alias("byte")).agg(F.sum(bit).cast("int").alias("value"))


def indicator(spark: SparkSession, n: int, ids: DataFrame) -> DataFrame:
    """id, value: 1 where listed, else 0."""
    return mask(spark, n, ids).select("id", F.col("on").cast("float").alias("value"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """id, value of alpha * x + y."""
    return y.join(x.withColumnRenamed("value", "x"), "id").select("id", (F.col("value") + F.lit(float(alpha)) * F.col("x")).alias("value"))


def soa_to_aos(*columns: DataFrame) -> DataFrame:
    """Component tables (id, value) -> id (component fastest), value. A union: ids are arithmetic, so nothing is joined."""
    n = len(columns)
    out = None
    for k, c in enumerate(columns):
        part = c.select((F.col("id") * n + k).alias("id"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def aos_to_soa(array: DataFrame, n: int) -> DataFrame:
    """id, value with component fastest -> id, c0..c(n-1)."""
    row = F.call_function("div", F.col("id"), F.lit(n))
    return array.groupBy(row.alias("row")).agg(*[F.max(F.when(F.col("id") % n == k, F.col("value"))).alias(f"c{k}") for k in range(n)]).withColumnRenamed("row", "id")


def view(array: DataFrame, first: int, stop: int) -> DataFrame:
    """A slice, numbered from 0."""
    return array.where((F.col("id") >= first) & (F.col("id") < stop)).withColumn("id", F.col("id") - first)


def as_type(array: DataFrame, kind: str) -> DataFrame:
    return array.withColumn("value", F.col("value").cast(kind))


def zeros_like(array: DataFrame) -> DataFrame:
    return array.withColumn("value", F.lit(0).cast(array.schema["value"].dataType))


def gather(array: DataFrame, index: DataFrame) -> DataFrame:
    """index: id, source -> id, value of array at source."""
    return index.join(array.withColumnRenamed("id", "source"), "source").select("id", "value")


def scatter(array: DataFrame, index: DataFrame) -> DataFrame:
    """index: id, target -> the array's values under their targets."""
    return array.join(index, "id").select(F.col("target").alias("id"), "value")


def coarse_entries(entries: DataFrame, most: int) -> DataFrame:
    """entries: id, index and any more -> those whose index is at most `most`, numbered anew from 0 in their old order. Null
    indices are left out."""
    kept = dense_ids(entries.where(F.col("index") <= most), ["id"], "at")
    return kept.select(F.col("at").alias("id"), *[c for c in entries.columns if c != "id"])


def override(array: DataFrame, ids: DataFrame, value: float) -> DataFrame:
    """array with listed entries overwritten."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return array.join(hit, "id", "left").select("id", F.when(F.col("hit"), F.lit(float(value))).otherwise(F.col("value")).alias("value"))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").unionByName(b.select("id")).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def unique(a: DataFrame) -> DataFrame:
    return a.select("id").distinct()


def condensed_ids(spark: SparkSession, n: int, gone: DataFrame) -> DataFrame:
    """id, new_id of 0..n-1 without the listed ids."""
    return dense_ids(spark.range(n).join(gone.select("id"), "id", "left_anti"), ["id"], "new_id")


def condensed_vector(array: DataFrame, n: int, gone: DataFrame) -> DataFrame:
    return array.join(condensed_ids(array.sparkSession, n, gone), "id").select(F.col("new_id").alias("id"), "value")


def remapped_vector(condensed: DataFrame, n: int, gone: DataFrame) -> DataFrame:
    """The inverse: zeros at the listed ids."""
    spark = condensed.sparkSession
    ids = condensed_ids(spark, n, gone)
    there = condensed.withColumnRenamed("id", "new_id").join(ids, "new_id").select("id", "value")
    return spark.range(n).join(there, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def min_max(array: DataFrame) -> DataFrame:
    return array.agg(F.min("value").alias("min"), F.max("value").alias("max"))


def has_nan(array: DataFrame) -> DataFrame:
    return array.agg(F.coalesce(F.max(F.isnan(F.col("value").cast("double"))), F.lit(False)).alias("has_nan"))


def shifted(points: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({c: (F.col(c) + float(d)).cast("float") for c, d in zip("xyz", by)})


def scaled(points: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({c: (F.col(c) * float(s)).cast("float") for c, s in zip("xyz", by)})


def rotated2(points: DataFrame, angle: float) -> DataFrame:
    """Rotation in the plane of x and y."""
    c, s = F.cos(F.lit(float(angle))), F.sin(F.lit(float(angle)))
    return points.withColumns({"x": (c * F.col("x") - s * F.col("y")).cast("float"), "y": (s * F.col("x") + c * F.col("y")).cast("float")})


def squared_distance(points: DataFrame, p: tuple[float, float, float]) -> DataFrame:
    d = sum(((F.coalesce(F.col(c), F.lit(0.0)) - float(q)) * (F.coalesce(F.col(c), F.lit(0.0)) - float(q)) for c, q in zip("xyz", p)), F.lit(0.0))
    return points.select("node_id", d.alias("d2"))


def grid_slice(field: DataFrame, ix: int) -> DataFrame:
    """The plane ix = const of a grid field."""
    return field.where(F.col("ix") == ix).select("iy", "iz", "value")


def grid_scaled(field: DataFrame, s: float) -> DataFrame:
    return field.withColumn("value", (F.col("value") * float(s)).cast("float"))


def point_function(points: DataFrame, f: Column) -> DataFrame:
    return points.select(F.col("node_id").alias("id"), f.alias("value"))
