from fractions import Fraction

import numpy as np
from pyspark.sql import types as T

from tessella.llm import whitening
from tessella.llm.queries import op11_embedding_whitening
from tests.llm.helpers import clashing

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def _expected(vectors):
    """Means, eigenvalues and vectors by a dense eigenvalue solver over exact integers."""
    x = np.array([[int(np.floor(1024.0 * float(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    dev = [sum(int(n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, dev, centred, e[::-1], v[:, ::-1]


def _check(rows, ids, vectors, k=8, close=1e-8):
    n, dev, centred, e, v = _expected(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    for c in range(1, k + 1):
        y = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        mine = np.array([got[i, c].whitened for i in ids])
        y = y if abs(mine - y).max() < abs(mine + y).max() else -y
        assert abs(mine - y).max() < close
        assert abs(got[ids[0], c].explained / (e[c - 1] / e.sum()) - 1) < 1e-9
    assert [got[i, 1].deviation for i in ids] == dev
    assert {r.n for r in rows} == {n}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whole_table_against_a_dense_solver(spark, sf_dir):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    _check(op11_embedding_whitening(spark, sf_dir).collect(), [i for i, _ in data], [v for _, v in data])


def test_steep_spectrum_needs_no_full_range(spark):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    # Whole numbers after scaling, of rank 8, so that rounding adds no flat tail.
    raw = rng.integers(-3, 4, size=(300, 8)) * (2 ** np.arange(8)[::-1]) @ np.sign(basis[:8])
    rows = [(i, [float(c) / 1024 for c in v], 0) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = whitening.fit_whitening(df.selectExpr("embedding as v"))
    assert fit.directions == 16
    _check(whitening.whitened_rows(df).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_flat_spectrum_grows_to_the_full_range(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(400, 24)))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert whitening.fit_whitening(df.selectExpr("embedding as v")).directions == 24
    rows = [(i, list(map(float, np.float32(v))), 0) for i, v, _ in rows]
    _check(whitening.whitened_rows(df).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, list(map(float, np.float32(rng.normal(size=3)))), 1) for i in range(30)]
    good += [good[0], (None, good[1][1], None)]  # a repeated row, a row without an identifier
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 2.0], 1), (104, [1.0, float("inf"), 2.0], 1), (105, [1.0, 2.0], 1)]
    out = whitening.whitened_rows(clashing(spark.createDataFrame(good + bad, SCHEMA), "v", "component", "n")).collect()
    assert len(out) == 32 * 3 and not {r.vec_id for r in out} & set(range(100, 106))
    assert sum(r.vec_id == 0 for r in out) == 6 and sum(r.vec_id is None for r in out) == 3
    n, dev, *_ = _expected([v for _, v, _ in good])
    assert {r.n for r in out} == {n} and {r.deviation for r in out if r.vec_id == 5} == {dev[5]}


def test_tables_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    out = whitening.whitened_rows(df).collect()
    assert len(out) == 4 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.explained == 0 for r in out)
    assert whitening.whitened_rows(df.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], SCHEMA)
    out = {(r.vec_id, r.component): r for r in whitening.whitened_rows(flat).collect()}
    assert out[0, 2].whitened is None and abs(out[4, 1].whitened) > 1 and out[0, 1].identity_error < 1e-9


def test_very_large_entries(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.5, 3.0], 0)], SCHEMA)
    out = whitening.whitened_rows(df).collect()
    assert len(out) == 6 and {r.deviation for r in out if r.vec_id == 1} == {None}
