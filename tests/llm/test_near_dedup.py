import random
import re

import numpy as np

from tessella.llm import near_dedup as N
from tessella.llm import shingles as S
from tessella.llm.components import components

from .helpers import clashing, docs

LOWER = {k: k + 32 for k in range(65, 91)}


def sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute(rows):
    ss = sets(rows)
    parent = {i: i for i, _ in ss}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(ss):
        for j, y in ss[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    return sorted((i, len(x), root(i), i == root(i)) for i, x in ss)


def variants(rng, base, n, changes):
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        yield " ".join(w)


def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", " \n", "one two", "one two", "One TWO", "one two three four five", "É é", "é é", "x " * 30_000]
    passage = " ".join(word() for _ in range(60))
    for _ in range(6):
        base = " ".join(word() for _ in range(rng.randrange(20, 200)))
        texts += list(variants(rng, base, 12, 6))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)]
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_against_brute_force(spark):
    rows = corpus()
    df = clashing(docs(spark, rows), "rep", "cls", "component", "n", "key")
    assert got(N.near_duplicates(df)) == brute(rows)
    assert got(N.near_duplicates(df, block=4)) == brute(rows)  # every bucket and component in blocks
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in brute(rows) if k]


def test_empty_and_null_ids(spark):
    assert N.near_duplicates(docs(spark, [])).collect() == []
    out = N.near_duplicates(docs(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out) == [(0, None, True), (2, 2, True), (4, 2, False), (4, 2, False)]


def test_estimate_and_links():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    for share in (0.2, 0.5, 0.75, 0.95):
        k = int(len(a) * share)
        b = np.concatenate([a[:k], rng.integers(0, 1 << 62, len(a) - k).astype(np.uint64)])
        true = k / (2 * len(a) - k)
        est = N.similarity(N.keys_and_signature(N.minima(a))[1], N.keys_and_signature(N.minima(np.unique(b)))[1])
        assert abs(est - true) < 0.2
    ss = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(50)]
    left, right = np.arange(0, 30), np.arange(20, 50)
    m = S.linked(ss, left, right, 40)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            u = len(np.union1d(ss[x], ss[y]))
            assert m[i, j] == (u > 0 and len(np.intersect1d(ss[x], ss[y])) * 100 >= 40 * u)


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 60)
    edges = [(names[i], names[i + 1]) for i in range(59) if i not in (20, 40)] + [(5_000_000, 5_000_000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(part) for part in (names[:21], names[21:41], names[41:]) for n in part}
    assert got == want


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_long_regular_words_are_told_apart(spark):
    """Polynomials of these words modulo a power of two are equal for any odd base."""
    df = docs(spark, [(1, thue_morse(1024)), (2, thue_morse(1024, 1)), (3, thue_morse(1024)), (4, "x " + thue_morse(2048) + " y"), (5, "x " + thue_morse(2048, 1) + " y")])
    out = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
