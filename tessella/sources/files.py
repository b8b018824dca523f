"""Files by path or, where they lie in a store that only Spark reads, by URI through the session's Hadoop file systems."""

from __future__ import annotations

import fnmatch
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a record that Spark reads from a remote file at once, at most.
RECORD_ROWS = 1 << 16


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def local(path: str) -> str:
    return path.removeprefix("file://")


def _store(folder: str):
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(folder: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if it isn't there."""
    if not is_remote(folder):
        return sorted(os.listdir(local(folder))) if os.path.isdir(local(folder)) else []
    fs, at = _store(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def matching(folder: str, pattern: str) -> list[str]:
    return [f"{folder.rstrip('/')}/{n}" for n in names(folder) if fnmatch.fnmatchcase(n, pattern)]


def size(path: str) -> int:
    if not is_remote(path):
        return os.path.getsize(local(path))
    fs, at = _store(path)
    return fs.getFileStatus(at).getLen()


def text(path: str) -> str | None:
    """A small text file's contents; None if it isn't there."""
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    if name not in names(folder):
        return None
    if not is_remote(path):
        return Path(local(path)).read_text()
    return SparkSession.active().read.text(path, wholetext=True).first()[0]


def record_rows(n: int, most: int = RECORD_ROWS) -> int:
    """The largest number of rows up to `most` that cuts n rows into equal records."""
    for k in range(min(n, most), 0, -1):
        if n % k == 0:
            return k
    return 1


def records(spark: SparkSession, path: str, record_bytes: int) -> DataFrame:
    """record (from 0), data: a file cut into records of equal length. Spark's own reader deals out byte ranges."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record_bytes)},
    )
    return spark.createDataFrame(rdd.map(lambda kv: (int(kv[0]), bytes(kv[1]))), "record long, data binary")
