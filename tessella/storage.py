"""Materialised tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of local sessions that name none; the setting can't be changed in a running session.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local session that names none (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
        d = _LOCAL[0]
    return d.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: fixes the rows and cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/tessella/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
