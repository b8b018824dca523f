"""What the corpus operators share: materialised tables, row packing and bounded sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that the text contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Largest number of rows that an operator broadcasts by its own decision, after it has counted them.
BROADCAST_ROWS = 200_000
#: And of bytes.
BROADCAST_BYTES = 64 << 20


#: The folder of local sessions that name none; the setting can't be changed in a running session.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local session that names none (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
        d = _LOCAL[0]
    return d.rstrip("/")


def materialize(df: DataFrame, small: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, fixes the rows (a later recomputation reads the same ones) and survives the loss of executors.
    small: rows of little size, written in no more files than the session runs tasks at once. Where Hadoop has no native
    library, a file's permissions start a process, which for an instant counts the executor's memory again.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """df as a table of the session in the shared folder, in buckets by the keys, one file a bucket: joins on the keys leave it
    in place. It stays until the session's owner drops it."""
    spark, name = df.sparkSession, f"tessella_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", f"{shared_dir(spark)}/tessella/{name}").saveAsTable(name)
    return spark.table(name)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(df: DataFrame, *apart: str) -> Column:
    """All columns but those named, as one struct: names in it can't clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in apart]
    return F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES; else as it is, to be joined by shuffle.

    Eight bytes stand for a number and for what text and arrays need beside their contents.
    """
    size = F.lit(8 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = size + 64 * F.greatest(F.lit(0), F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)))
    n, held = df.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= BROADCAST_BYTES else df


#: What a batch between the JVM and Python may hold. The default of 10,000 rows is 30 MB of ordinary documents on both
#: sides at once, and any amount of long ones.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows of a batch of a few numbers each: about a megabyte.
NUMBER_ROWS = 20_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


@contextmanager
def number_batches(spark: SparkSession) -> Iterator[None]:
    """Larger batches for what runs inside: rows of a few numbers, whose bytes stay far below BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(NUMBER_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)
