import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing as P

from .helpers import clashing, docs

TEXTS = [None, "", "Hello World's café 12½", "ß" * 30, "<|endoftext|> x", "日本語 text", "á b", "word " * 9000, "x\x85y\xa0z \x1c q", "don't WE'LL '' ''s İstanbul", "the cat sat " * 700, *["some short text %d" % i for i in range(400)], *["longer text with words " * i for i in range(1, 60)]]


def check(rows, want, limits=P.Limits()):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert sum(len(v) for v in by_doc.values()) == len(rows)
    for d, ids in want.items():
        ps = sorted(by_doc[d], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in ps)
        at = 0
        for r in ps:
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    waste = 0
    for ps in by_seq.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(ps) <= limits.segments
        waste += 0 if at & (at - 1) == 0 else limits.tokens - at
    return waste / max(1, sum(r.length for r in rows))


def test_exact_ids_and_little_padding(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = list(enumerate(TEXTS))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    df = clashing(docs(spark, rows), "id", "ids", "start", "whole").repartition(3)
    assert check(P.packed_documents(df).collect(), want) < 0.02
    assert P.encoder(public_tokenizers.path("word_bpe_49k.json")).by_word
    small = P.packed_sequences(P.tokenized(df), window_tokens=5000).withColumnRenamed("id", "doc_id").selectExpr("*", "crc32(ids) as ids_crc32")
    assert check(small.collect(), want) < 0.02
    assert P.packed_documents(docs(spark, [])).collect() == []


def test_whole_examples_keep_all_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, bytes(4 * int(n)), int(min(n, m)), True) for i, (n, m) in enumerate(zip(rng.integers(1, 900, 500), rng.integers(1, 500, 500)))]
    rows.append((500, bytes(4 * 1000), 900, True))
    limits = P.Limits(1024, 4, 512)
    df = spark.createDataFrame(rows, "id long, ids binary, loss long, whole boolean").coalesce(1)
    got = P.packed_sequences(df, limits).collect()
    assert sorted((r.id, r.start, r.length) for r in got) == [(i, 0, len(b) // 4) for i, b, _, _ in rows]
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for ps in seqs.values():
        assert sum(r.length for r in ps) <= 1024 and len(ps) <= 4
        assert sum(rows[r.id][2] for r in ps) <= 512 or [r.id for r in ps] == [500]
    assert len(seqs) < 1.15 * max(sum(len(b) // 4 for _, b, *_ in rows) / 1024, sum(x for _, _, x, _ in rows) / 512)


def test_ids_of_odd_texts_equal_whole_encodings():
    """Latin-1 with every white space and control character, contractions, added tokens, other scripts, empties."""
    import random

    from tessella.llm.packing import _default_path, encoder

    enc = encoder(_default_path())
    assert enc.by_word
    rng = random.Random(5)
    signs = "".join(map(chr, range(256))) + "   '''sstdrelmv  \n\t\x1c\x85"
    texts = ["", " ", "  \n", "\x1c", "<|endoftext|> Hi", "日本 x", "x" * 20000, "\xa0\x85", "a " * 300000, *("".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(2000))]
    assert enc.encode(texts) == [enc._bytes(enc._ids(t)) for t in texts]
    assert enc.encode([]) == [] and enc.encode(["", " "]) == [b"", b""]


def test_many_short_and_repeated_texts_leave_little_padding(spark):
    df = docs(spark, [(i % 5000, "a b") for i in range(10_000)])
    rows = P.packed_documents(df).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    total = sum(r.length for r in rows)
    per = defaultdict(int)
    for r in rows:
        per[r.sequence_id] += r.length
    assert total == 10_000 * rows[0].doc_tokens
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in per.values()) < 0.01 * total
