import hashlib
import re

from tessella.llm.decontaminate import contamination, drop_contaminated

from .helpers import clashing, docs

LOWER = {k: k + 32 for k in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, items):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for ws, own in win.items():
            for k in range(len(w) - len(ws) + 1):
                if tuple(w[k : k + len(ws)]) == ws:
                    hit |= set(range(k, k + len(ws)))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "short Item"), (10, "One"), (3, None), (4, "..."), (5, "a a a a a a a a a a a a"), (6, " ".join(f"w{i}" for i in range(14))), (7, "eins zwei drei"), (8, "Éé \U0001f600x y z 1 2 3 4 5 6 7")]
DOCS = [
    (1, "x " + " ".join(f"W{i}" for i in range(14)) + " y"), (2, " ".join(f"w{i}" for i in range(9))), (3, "a " * 25), (4, "a " * 9), (5, None), (6, ""), (7, "?!"), (8, "the short. ITEM one-two"),
    (9, "eins zwei vier drei"), (10, "eins, zwei, drei"), (11, "Éé \U0001f600x y z 1 2 3 4 5 6 7 Éé \U0001f600x"), (12, "v " * 20_000 + " ".join(f"w{i}" for i in range(2, 12)) + " v" * 20_000), (13, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w8 w9 w10"), (5, None), (14, "w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (14, "w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"),
]


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_against_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = clashing(docs(spark, DOCS), "item_id", "th", "w", "pos")
    assert got(contamination(df, items)) == brute(DOCS, ITEMS)
    assert got(contamination(df, items, broadcast_rows=0)) == brute(DOCS, ITEMS)
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(DOCS, ITEMS) if not r[-1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(contamination(docs(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string"))) == []
    assert got(contamination(docs(spark, DOCS[:4]), none)) == brute(DOCS[:4], [])
