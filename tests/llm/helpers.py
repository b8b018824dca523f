"""Rows that every operator has to handle."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """rows: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


def clashing(df, *names):
    """df with extra columns that bear an operator's own names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})
