import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import language_id as L

from .helpers import DOCS, clashing, docs

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_by_text_alone(spark):
    d = spark.read.parquet(SF)
    model = L.fit(d.where("doc_id % 2 = 0"))
    rest = d.where("doc_id % 2 = 1")
    out = L.identified(rest, model).join(rest.select("doc_id", F.col("lang").alias("true")), "doc_id").toPandas()
    assert (out.lang == out.true).mean() > 0.97
    assert out.kept.mean() > 0.99
    assert L.drop_rejected(rest, model).columns == rest.columns


def test_edge_cases_and_rejection(spark):
    d = spark.read.parquet(SF)
    model = L.fit(d)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "ы" * 500), (5, "Это не один из языков корпуса " * 20), (6, "the"), (7, "the " * 50_000), (7, "the " * 50_000), (8, "<html lang='fr'> of the and")]
    df = clashing(docs(spark, rows), "id", "th", "host", "ll")
    got = {r.doc_id: r for r in L.identified(df, model).collect()}
    assert [got[k].lang for k in (1, 2, 3, 4, 5, 7)] == ["und"] * 5 + ["en"]
    assert [got[k].kept for k in (1, 4, 6, 7)] == [False, False, True, True]
    assert got[8].declared == "fr"
    assert sorted(r.doc_id for r in L.drop_rejected(df, model).collect()) == [6, 7, 7, 8]
    empty = spark.createDataFrame([], DOCS)
    assert L.identified(empty, model).collect() == []
    assert {r.lang for r in L.identified(df, L.fit(empty)).collect()} == {"und"}


def test_fusion_against_brute_force(spark):
    d = spark.read.parquet(SF).limit(120)
    model = L.fit(d)
    rows = [(r.doc_id, r.text[:12], ("a.one.de", "b.one.de", "x.fr", "plain")[r.doc_id % 4], ("en", None, "xx")[r.doc_id % 3]) for r in d.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string, said string")
    got = {r.doc_id: r for r in L.identified(df, model, host="site", declared="said").collect()}
    classes = [*model.languages, "und"]
    k = len(classes)
    ev = {}
    for i, t, h, s in rows:
        x = model.likelihoods(t)
        if x is None:
            continue
        for lang, right in ((s, L.DECLARED), (L.SUFFIXES.get(h.split(".")[-1]) if "." in h else None, L.SUFFIX)):
            if lang in model.languages:
                x = x + [math.log(right if c == lang else (1 - right) / (k - 1)) for c in classes]
        ev[i] = x
    soft = {i: np.exp(x - x.max()) / np.exp(x - x.max()).sum() for i, x in ev.items()}
    host = {i: h for i, _, h, _ in rows}
    parent = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    total = sum(soft.values())
    top = (total + 1) / (total.sum() + k)
    for i, x in ev.items():
        p = sum(v for j, v in soft.items() if parent(host[j]) == parent(host[i]))
        q = (p + L.SMOOTHING * top) / (p.sum() + L.SMOOTHING)
        s = sum(v for j, v in soft.items() if host[j] == host[i])
        y = x + np.log((s + L.SMOOTHING * q) / (s.sum() + L.SMOOTHING))
        y = np.exp(y - y.max()) / np.exp(y - y.max()).sum()
        assert got[i].lang == classes[int(y.argmax())] and abs(got[i].posterior - y.max()) < 1e-9


def test_rare_and_many_languages(spark):
    """Spanish is 1 row in 2000; a row a language is too little to reject by; more than 64 languages have models."""
    d = spark.read.parquet(SF).select("doc_id", "text", "lang")
    es = [r.text for r in d.where("lang = 'es' and length(text) > 500").orderBy("doc_id").limit(60).collect()]
    en = d.where("lang = 'en'").select("text").limit(300)
    many = en.crossJoin(spark.range(200)).select(F.concat_ws(" ", "text", F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(t, "es") for t in es[:30]] + [(es[0][:500], "one")] + [(chr(0x4E00 + 40 * k + i % 7) * 9, f"l{k:03}") for k in range(90) for i in range(12)], "text string, lang string")
    model = L.fit(many.unionByName(rare))
    assert len(model.languages) == 93 and "es" in model.fitted and "one" not in model.fitted
    rows = [(k, t, "es") for k, t in enumerate(es[30:])] + [(100, "\u044b\u044c\u0449" * 300, "one"), (101, "\u044b\u044c\u0449" * 300, "es"), (102, "12", "one"), (103, "\u044b\u044c\u0449" * 300, "")]
    got = {r.doc_id: r for r in L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, host=None, declared="lang").collect()}
    assert {(got[k].lang, got[k].kept) for k in range(len(es) - 30)} == {("es", True)}
    assert [got[k].kept for k in (100, 101, 102, 103)] == [True, False, False, False]


def test_every_kind_of_evidence_decides_where_the_others_are_silent(spark):
    """A word that two languages share, told apart by declaration, address suffix, host and the host's parent in turn."""
    d = spark.read.parquet(SF).where("length(text) > 400")
    model = L.fit(spark.read.parquet(SF))
    two = [model.languages.index(x) for x in ("de", "fr")]
    apart = lambda w: abs(np.subtract(*model.likelihoods(w)[two])) + max(0.0, model.likelihoods(w).max() - model.likelihoods(w)[two].min())
    word = min(("".join(x) for n in (1, 2) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=n)), key=apart)
    texts = {lang: [r.text for r in d.where(f"lang = '{lang}'").orderBy("doc_id").limit(25).collect()] for lang in ("de", "fr")}
    rows, k = [], 1000
    for lang, site in (("fr", "a.one.org"), ("de", "a.two.org")):
        for t in texts[lang]:
            rows.append((k, t, site, None))
            k += 1
    asked = {1: ("plain", None), 2: ("plain", "de"), 3: ("plain", "fr"), 4: ("x.de", None), 5: ("x.fr", None), 6: ("a.one.org", None), 7: ("a.two.org", None), 8: ("b.one.org", None), 9: ("b.two.org", None)}
    rows += [(i, word, site, said) for i, (site, said) in asked.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string, said string")
    got = {r.doc_id: r.lang for r in L.identified(df, model, host="site", declared="said").collect()}
    assert (got[2], got[3]) == ("de", "fr")  # declarations
    assert (got[4], got[5]) == ("de", "fr")  # suffixes
    assert (got[6], got[7]) == ("fr", "de")  # what else the host has
    assert (got[8], got[9]) == ("fr", "de")  # what the host's siblings have
    alone = {r.doc_id: r.lang for r in L.identified(df.where("doc_id < 10"), model, host=None).collect()}
    assert len({alone[i] for i in asked}) == 1
