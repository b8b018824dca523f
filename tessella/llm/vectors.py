"""Vectors in list columns: their common length, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_column(df: DataFrame, name: str) -> Column:
    """The column as array<float> or array<double>: other numbers become doubles."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return c if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else c.cast("array<double>")


def common_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the non-empty vectors, of equally frequent ones the largest; 0 if there are none."""
    sizes = df.select(F.size(F.col(vector)).alias("d")).where("d > 0").groupBy("d").count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return int(top.d) if top else 0


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that are vectors of this length without null or non-finite entries, and those as doubles."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    values = pc.list_flatten(column.take(pa.array(at)) if len(at) < len(column) else column).to_numpy(zero_copy_only=False)  # nulls become NaN
    values = values.astype(np.float64, copy=False).reshape(-1, dim)
    good = np.isfinite(values).all(1)
    return at[good], values[good]


def scaled(values: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * value) as 64-bit integers; what is beyond 2^62 stays there."""
    return np.clip(np.floor(values * factor), -(2.0**62), 2.0**62).astype(np.int64)
