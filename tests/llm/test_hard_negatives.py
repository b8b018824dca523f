import numpy as np
from pyspark.sql import types as T

from tessella.llm import hard_negatives as hn
from tessella.llm.queries import op13_hard_negatives
from tests.llm.helpers import clashing

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _brute(rows):
    """By definition, with whole numbers of any size."""
    good = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]))
    out = []
    for i, label, x in {(r[0], r[1], tuple(r[2])) for r in good if r[0] % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in good if j != i)
        for s, j, _ in [t for t in scored if t[2]][:5]:
            near = [(t, n) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(near[:5])]
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = _rows(op13_hard_negatives(spark, sf_dir))
    assert got == _brute(rows) and len(got) > 50


def test_many_shards_and_blocks_ties_and_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(hn, "SHARD", 150)
    monkeypatch.setattr(hn, "BLOCK", 4)
    monkeypatch.setattr(hn, "PIECE", 2)
    monkeypatch.setattr(hn, "DIGIT", 6)
    monkeypatch.setattr(hn, "HELD", 1 << 10)
    rng = np.random.default_rng(5)
    common = [0.5, 0.25, -0.5, 0.125]
    rows = [(i, int(rng.integers(0, 3)), common if rng.random() < 0.4 else [float(c) for c in np.float32(rng.integers(-4, 5, 4) / 8)]) for i in range(1000)]
    rows += [rows[200], rows[3], rows[3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = _brute(rows)
    assert _rows(hn.hard_negatives(df)) == expected and len(expected) > 100
    monkeypatch.setattr(hn, "SALTS", 3)
    monkeypatch.setattr(hn, "bounded", lambda df: df)  # blocks too large to broadcast
    assert _rows(hn.hard_negatives(df)) == expected


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 4, [float(c) for c in np.float32(rng.normal(size=6))]) for i in range(0, 300)]
    rows += [(None, 1, rows[0][2]), (400, None, rows[0][2]), (500, 1, None), (600, 1, []), (700, 1, [1.0] * 5 + [None]), (800, 1, [1.0] * 5 + [float("nan")]), (900, 1, [float("-inf")] * 6)]
    rows += [(1000, 2, [1e5] * 6), (1001, 2, [9e4] * 6), (1002, 3, [8.5e4] * 6), (1003, 1, [0.0] * 6), (1100, 3, [0.0] * 6)]
    df = clashing(spark.createDataFrame(rows, SCHEMA), "id", "block", "score")
    got = _rows(hn.hard_negatives(df))
    assert got == _brute(rows) and any(r[0] == 1000 for r in got)
    shorter = df.unionByName(clashing(spark.createDataFrame([(1200, 1, [1.0, 2.0])], SCHEMA), "id", "block", "score"))
    assert _rows(hn.hard_negatives(shorter)) == got
    assert hn.hard_negatives(df.limit(0)).collect() == []
    assert hn.hard_negatives(df.where("vec_id % 100 <> 0")).collect() == []
    alone = spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0])], SCHEMA)
    assert hn.hard_negatives(alone).collect() == []


def test_scores_that_need_whole_numbers(spark):
    big = float(np.float32(3e12))
    rows = [(0, 1, [1.0, big]), (100, 1, [2.0, 1.0]), (1, 1, [0.5, 0.0]), (2, 2, [0.45, 0.0]), (3, 2, [0.25, 0.0]), (4, 2, [1.0, 1e-3])]
    assert _rows(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == [(a, p, r, n, min(s, hn.TOP), min(t, hn.TOP)) for a, p, r, n, s, t in _brute(rows)]
