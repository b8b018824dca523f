"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination and packing, each over all that came before.

Null and empty texts count as equal and empty: exact dedup leaves one, near dedup and decontamination leave it, packing makes
it a document of its end token. Rows that repeat identifier and text are exact copies. An empty table passes as one. Texts
are read whole, and other columns are carried up to packing, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import shared_dir
from tessella.llm.decontaminate import drop_contaminated
from tessella.llm.exact_dedup import drop_exact_duplicates
from tessella.llm.language_id import drop_rejected, fit
from tessella.llm.near_dedup import drop_near_duplicates
from tessella.llm.packing import packed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is none that the models know go."""
    return drop_rejected(docs, fit(docs), declared="lang")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the most code points, then the smallest identifier."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences of at most 2048 tokens."""
    return packed_documents(docs).drop("ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Language models, MinHash groups and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}_{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
