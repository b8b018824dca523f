import hashlib
import re
from unittest.mock import patch

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessella.llm.exact_dedup import _runs, drop_exact_duplicates, exact_duplicates

from .helpers import clashing, docs


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)


def got(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a b"), (8, "x" * 200_000), (9, "x" * 199_999), (10, " " + "x" * 200_000), (0, "a  b")]
    assert got(exact_duplicates(docs(spark, rows))) == brute(rows)
    kept = drop_exact_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 7, 9, 10]


def test_hot_group_crosses_partitions(spark):
    rows = [(i, "copy of a text" if i % 3 else f"text {i}") for i in range(3000)]
    df = docs(spark, rows).repartition(16)
    assert got(exact_duplicates(df)) == brute(rows)
    assert sum(r.kept for r in exact_duplicates(df).collect()) == 1001
    assert drop_exact_duplicates(df).count() == 1001


def test_a_long_run_holds_identifiers_alone():
    """The pass over one partition of copies: what it holds while the run is open grows with the rows, not with their texts."""
    import io
    import tracemalloc

    import pyarrow as pa

    text, n = "y" * 20_000, 100
    sink = io.BytesIO()
    schema = pa.schema([("norm", pa.string()), ("neg", pa.int32()), ("id", pa.int64())])
    with pa.ipc.new_stream(sink, schema) as w:
        for k in range(30):
            w.write_batch(pa.record_batch([pa.array([text] * n), pa.array([-len(text)] * n, pa.int32()), pa.array(range(k * n, k * n + n))], schema=schema))
    held = []

    def batches():
        for b in pa.ipc.open_stream(io.BytesIO(sink.getvalue())):
            yield b
            held.append(tracemalloc.get_traced_memory()[0] - before)

    with patch("tessella.llm.exact_dedup.TaskContext") as task:
        task.get.return_value.partitionId.return_value = 0
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0] + len(sink.getvalue())
        rows = [i for b in _runs(False, ["id"])(batches()) for i in b.column("id").to_pylist()]
        tracemalloc.stop()
    assert rows == list(range(30 * n))
    assert max(held) < 5 * n * len(text)


def test_repeated_rows_leave_one(spark):
    df = docs(spark, [(1, "a"), (1, "a"), (1, "a"), (2, "b")])
    assert sorted(r.doc_id for r in drop_exact_duplicates(df).collect()) == [1, 2]
    assert sum(r.kept for r in exact_duplicates(df).collect()) == 2


def test_empty_table_clashes_and_null_ids(spark):
    assert exact_duplicates(docs(spark, [])).collect() == []
    df = clashing(docs(spark, [(None, "a"), (3, "a")]), "keep_id", "norm", "p", "kept")
    assert [r.doc_id for r in drop_exact_duplicates(df).collect()] == [3]
    assert drop_exact_duplicates(df).columns == df.columns


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \né", max_size=4), max_size=30))
def test_random(spark, texts):
    rows = list(enumerate(texts))
    assert got(exact_duplicates(docs(spark, rows))) == brute(rows)
