import re

import pytest
from pyspark.sql import functions as F

from .test_decontaminate import words as bench_words
from .test_near_dedup import brute as near_brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_against_brute_force(spark, pipeline):
    """Every decision but the language models' is made again in plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessella.llm.language_id import fit, identified

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in identified(docs, fit(docs), declared="lang").where("kept").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in kept}
    assert len(kept) >= 0.95 * docs.count()
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    kept = {min(g)[1] for g in groups.values()}
    kept = {i for i, _, _, stays in near_brute([(i, texts[i]) for i in sorted(kept)]) if stays}
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = bench_words(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[k : k + 10]), set()).add(tuple(w[k : k + 10]))
    clean = lambda w: not any(tuple(w[k : k + n]) in ws for n, ws in windows.items() for k in range(len(w) - n + 1))
    kept = {i for i in kept if clean(bench_words(texts[i]))}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept
    assert check(rows, {i: [*t.encode(texts[i], add_special_tokens=False).ids, 1] for i in kept}) < 0.03


def test_stages_on_odd_rows_and_an_empty_table(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, None, None, None)], docs.schema)).withColumn("kept", F.lit("clash"))
    for df in (odd, odd.where("false")):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, df, SF)
            assert k == len(pipeline.STAGES) - 1 or out.columns == df.columns
            out.collect()
