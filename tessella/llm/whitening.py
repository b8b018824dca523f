"""Whitening of embeddings: a randomised range finder over all centred rows, Rayleigh-Ritz for the components.

The rows' covariance V is never asked for whole at first: a random start of COMPONENTS + OVERSAMPLE directions goes through
POWER_PASSES passes Q -> orth(V Q), each a sum over all centred rows that tasks form for their own partition and one
aggregation adds up. Rayleigh-Ritz in that range gives eigenvalues and vectors. A component's angle to the true one is at
most its residual over its distance to the other eigenvalues; where that isn't below ANGLE, as for a flat spectrum, the
range grows to the full dimension, in which Rayleigh-Ritz is exact to rounding. Sums of a pass are all that reaches the
driver: dimension x directions numbers. Rows never move: there is no shuffle but of those sums.

Defined results: vectors that are null, empty, hold null or non-finite entries, or are not of the most frequent length
have no row in the result; repeated rows count and are returned as often as they occur; equal eigenvalues have any
orthonormal basis of their space; a component without variance (fewer rows than dimensions, one row, equal rows) has
whitened null and isn't part of identity_error, which is null if there is no other; a deviation beyond 64 bits is null;
entries beyond 2^62 after scaling stay there; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .vectors import common_length, dense, scaled, vector_column

COMPONENTS, OVERSAMPLE, POWER_PASSES = 8, 8, 2
#: Largest sine of the angle between a component and the true eigenvector.
ANGLE = 1e-12
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
_LONG = (1 << 63) - 1


class Whitening(NamedTuple):
    dim: int
    n: int
    sums: tuple[int, ...]
    mean: np.ndarray  # of each dimension
    vectors: np.ndarray  # a column for each component
    values: np.ndarray  # eigenvalues, falling
    trace: float
    directions: int  # of the range that was needed


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    at, values = dense(column, dim)
    return at, scaled(values, SCALE) + SHIFT


def _totals(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of every dimension. Halves of the integers are added apart, so nothing overflows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            _, x = _integers(b.column(0), dim)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low), pa.array(np.full(dim, n))], names=["k", "high", "low", "n"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.mapInArrow(part, "k long, high long, low long, n long").groupBy("k").agg(big("high"), big("low"), F.sum("n").alias("n")).orderBy("k").collect()
    return (int(found[0].n), tuple((int(r.high) << 32) + int(r.low) for r in found)) if found else (0, ())


def _summed(rows: DataFrame, dim: int, form, size: int) -> np.ndarray:
    """form(x), an array of so many numbers for a batch of integer vectors, added over all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            _, x = _integers(b.column(0), dim)
            if len(x):
                total += form(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def _times_covariance(rows: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    def form(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ q)

    return _summed(rows, len(mean), form, q.size).reshape(q.shape) / n


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = POWER_PASSES, angle: float = ANGLE, seed: int = 11) -> Whitening | None:
    """rows: a column `v` of vectors. None if there is no whole vector."""
    dim = common_length(rows, "v")
    n, sums = _totals(rows, dim) if dim else (0, ())
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    trace = float(_summed(rows, dim, lambda x: ((x - mean) ** 2).sum(0), dim).sum()) / n
    k = min(components, dim)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, k + oversample))))[0]
    while True:
        full = q.shape[1] == dim
        for _ in range(0 if full else passes):
            q = np.linalg.qr(_times_covariance(rows, n, mean, q))[0]
        z = _times_covariance(rows, n, mean, q)
        t = q.T @ z
        values, w = np.linalg.eigh((t + t.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        vectors = q @ w
        residual = np.linalg.norm(z @ w - vectors * values, axis=0)[:k]
        gap = np.array([np.abs(np.delete(values, i) - values[i]).min(initial=np.inf) for i in range(k)])
        if full or (residual <= angle * gap).all():
            return Whitening(dim, n, sums, mean, vectors[:, :k], np.maximum(values[:k], 0.0), trace, q.shape[1])
        rest = np.random.default_rng(seed + 1).normal(size=(dim, dim - q.shape[1]))
        q = np.linalg.qr(np.concatenate([q, rest], 1))[0]


def _weights(fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Components over the root of their eigenvalues, zero where there is no variance; which have some."""
    real = fit.values > fit.dim * np.finfo(float).eps * max(fit.trace, 0.0)
    return fit.vectors * np.where(real, 1 / np.sqrt(np.where(real, fit.values, 1.0)), 0.0), real


def identity_error(rows: DataFrame, fit: Whitening) -> float | None:
    """Largest entry by amount of the whitened rows' covariance minus the identity, measured over all rows."""
    w, real = _weights(fit)
    w, mean = w[:, real], fit.mean
    k = w.shape[1]
    if not k:
        return None

    def form(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ w
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    total = _summed(rows, fit.dim, form, k + k * k) / fit.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Sum over dimensions of (n * x - sum)^2, exactly; null beyond 64 bits."""
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if most <= _LONG:
        t = n * x - np.array(sums, np.int64)
        if int(np.abs(t).max()) ** 2 * x.shape[1] <= _LONG:
            return pa.array((t * t).sum(1))
    t = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return pa.array([v if v <= _LONG else None for v in t], pa.int64())


def whitened_rows(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, **how: object) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every whole vector."""
    rows = bounded_batches(df.select(vector_column(df, vector).alias("v"), F.col(f"`{vec_id}`").alias("vec_id")))
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    fit = fit_whitening(rows.select("v"), components, **how)
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows.select("v"), fit)
    w, real = _weights(fit)
    k = len(real)
    explained = fit.values / fit.trace if fit.trace > 0 else np.zeros(k)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _integers(b.column(0), fit.dim)
            m = len(at)
            if not m:
                continue
            of = pa.array(np.repeat(np.arange(m), k))
            y = pa.array(((x - fit.mean) @ w).ravel(), mask=np.tile(~real, m))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(at)).take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                    _deviation(x, fit.n, fit.sums).take(of), y, pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64()),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(part, schema)
