"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of
* the text's likelihood under byte-trigram models (hashed into BUCKETS, add-one-half smoothed), at most EVIDENCE
  trigrams' worth of it, so that long texts don't drown everything else;
* the declared language's likelihood: a declaration is right with probability DECLARED, else any other language; it comes
  from a column or from an opening html tag's lang attribute inside the text;
* the address suffix's likelihood, where a host ends in a country code that speaks for a language;
* a prior of the host, smoothed towards its parent domain's and that towards the corpus's: soft counts from all
  documents, summed by grouped aggregation (partial sums before the shuffle, so a host with a third of all rows is a row
  a task). Priors are broadcast only after they were counted.
One more class, "und", has a flat trigram likelihood and takes texts that no model explains.

The models are fitted for every label on about SAMPLE rows each (all of them where a label has fewer texts, by a count over
the whole table), so a language's share of the table doesn't matter. Weights are sparse; driver and tasks hold them for all
labels, which must be languages and not free text. Counts, priors and decisions use every row.

A label counts as fitted with FITTED texts and a likelihood of its own trigrams, each left out of the counts in turn, above
UNKNOWN. Other models are too flat to tell a clean text from noise: a text with letters that is declared in a language
without a fitted model is kept, whatever its posterior.

A class that is NEAR or more below the best one by evidence isn't stored: no prior makes it matter to a double.

Defined results: a text without any letter (null, empty, digits) is "und" and rejected; a null host has the corpus's
prior; an unknown declaration is no evidence; ties go to the first language in alphabetical order; repeated rows get
equal results; an empty table gives an empty table; without labelled rows everything is "und"; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, free, materialize

BUCKETS = 1 << 16
#: Labelled rows of each language that the models are fitted on, and the texts that a fitted one has at least.
SAMPLE, FITTED = 3000, 10
#: Languages whose counts a task holds at once while fitting, half a MB each.
HELD = 32
EVIDENCE = 200
#: Priors of 10^9 rows differ by less than 70.
NEAR = 120.0
#: Natural log of a trigram's probability under "und"; texts in a modelled language are at -8 or above.
UNKNOWN = -9.6
DECLARED, SMOOTHING = 0.9, 20.0
#: Country codes of host names that speak for a language, and how often they are right.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt"}
SUFFIX = 0.8
MARKUP = r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})"""
UND = "und"
_TABLE = np.full(256, 32, np.uint8)
_TABLE[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def _trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams that hold a letter; other bytes count as blanks, runs of them as one."""
    b = _TABLE[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    blank = b == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    b = b[keep].astype(np.uint32)
    if len(b) < 2:
        return np.zeros(0, np.uint32)
    b = np.concatenate([[np.uint32(32)], b])
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


class Model:
    """Log likelihoods: the flat one of a language and what a trigram adds to it, for the pairs that occur, ordered by bucket.

    lang (a place in languages), bucket, n: trigram counts, a pair once; texts: fitted on so many, by language.
    """

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray, texts: list[int]):
        self.languages = languages
        order = np.lexsort((lang, bucket))
        self.lang, n = lang[order].astype(np.int32), n[order].astype(np.float64)
        self.start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        total = np.bincount(self.lang, n, len(languages))
        norm = np.log(total + 0.5 * BUCKETS)
        self.flat, self.added = math.log(0.5) - norm, np.log((n + 0.5) / 0.5)
        own = np.bincount(self.lang, n * np.log(n - 0.5), len(languages)) / np.maximum(total, 1) - norm
        self.fitted = [x for k, x in enumerate(languages) if texts[k] >= FITTED and own[k] > UNKNOWN]

    def likelihoods(self, text: str) -> np.ndarray | None:
        """By language and last "und"; null: no letters."""
        grams = _trigrams(text)
        if not len(grams):
            return None
        at, n = np.unique(grams, return_counts=True)
        held = self.start[at + 1] - self.start[at]
        pairs = np.arange(held.sum()) + np.repeat(self.start[at] - np.cumsum(held) + held, held)
        own = np.bincount(self.lang[pairs], self.added[pairs] * np.repeat(n, held), len(self.languages)) + len(grams) * self.flat
        return np.append(own, UNKNOWN * len(grams)) * min(1.0, EVIDENCE / len(grams))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Trigram counts by language over about so many labelled rows of each, the same ones in every run over the same table."""
    lang = F.lower(F.col(f"`{label}`").cast("string"))
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(lang.alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where(~F.col("lang").isin("", UND))
    # Texts, not rows: equal texts have equal hashes, and are drawn or left together.
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    languages = sorted(sizes)
    large = [x for lang, n in sizes.items() if n > sample for x in (F.lit(lang), F.lit(int(sample / n * (1 << 30))))]
    if large:
        least = F.element_at(F.create_map(*large), F.col("lang"))
        rows = rows.where(least.isNull() | (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < least))
    code = {lang: k for k, lang in enumerate(languages)}

    def batch(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if code[lang] not in sums and len(sums) == HELD:
                    yield from batch(sums)
                    sums = {}
                have = sums.setdefault(code[lang], np.zeros(BUCKETS, np.int64))
                np.add.at(have, _trigrams(t), 1)
        yield from batch(sums)

    got = bounded_batches(rows).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return Model(languages, *(got[c].to_numpy(np.int64) for c in ("lang", "bucket", "n")), [sizes[lang] for lang in languages])


def _parent(host: Column) -> Column:
    """The last two labels of a dotted name, else the empty name that stands for the corpus."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2)).otherwise(F.lit(""))


def _normalised(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", host: str | None = "source", declared: str | None = None, least: float = 0.5) -> DataFrame:
    """id, th (hash of the text), lang, posterior, text_lang (by likelihood alone), declared, kept (not "und" and posterior
    at least `least`, or declared in a language without a fitted model)."""
    classes = [*model.languages, UND]
    k = len(classes)
    place = {lang: i for i, lang in enumerate(model.languages)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, near, evidence = [], [], []
            for t, host, said in zip(b.column("text").to_pylist(), b.column("host").to_pylist(), b.column("declared").to_pylist()):
                x = model.likelihoods(t)
                if x is None:
                    best.append(UND), near.append(None), evidence.append(None)
                    continue
                best.append(classes[int(x.argmax())])
                for lang, right in ((said, DECLARED), (SUFFIXES.get(host.rsplit(".", 1)[1]) if "." in host else None, SUFFIX)):
                    if lang in place:
                        factor = np.full(k, math.log((1 - right) / max(1, k - 1)))
                        factor[place[lang]] = math.log(right)
                        x = x + factor
                at = np.flatnonzero(x > x.max() - NEAR)
                near.append(at.tolist()), evidence.append(x[at].tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "th", "host", "declared")), pa.array(best, pa.string()), pa.array(near, pa.list_(pa.int32())), pa.array(evidence, pa.list_(pa.float64()))], names=["id", "th", "host", "declared", "text_lang", "near", "evidence"])

    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    markup = F.nullif(F.regexp_extract(t, MARKUP, 1), F.lit(""))
    said = F.lower(F.coalesce(F.col(f"`{declared}`").cast("string"), markup) if declared else markup)
    name = F.lower(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))) if host else F.lit("")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(t).alias("th"), name.alias("host"), said.alias("declared"), t.alias("text"))
    rows = materialize(bounded_batches(rows).mapInArrow(score, "id long, th long, host string, declared string, text_lang string, near array<int>, evidence array<double>"))

    # Soft counts by host, then by parent, then over all: the corpus's prior is flat-smoothed, the others by the one above.
    soft = rows.where("evidence is not null").select("host", "near", _normalised(F.col("evidence")).alias("soft"))
    soft = soft.select("host", F.explode(F.arrays_zip("near", "soft")).alias("x")).select("host", F.col("x.near").alias("c"), F.col("x.soft").alias("s"))
    hosts = materialize(soft.groupBy("host", "c").agg(F.sum("s").alias("s")).withColumn("parent", _parent(F.col("host"))))
    whole = {r.c: r.s for r in hosts.groupBy("c").agg(F.sum("s").alias("s")).collect()}
    top = F.array(*[F.lit((whole.get(i, 0.0) + 1.0) / (sum(whole.values()) + k)) for i in range(k)])
    table = lambda s: F.map_from_entries(F.collect_list(F.struct("c", s)))
    parents = hosts.groupBy("parent", "c").agg(F.sum("s").alias("p")).groupBy("parent").agg(F.sum("p").alias("n_parent"), table("p").alias("of_parent"))
    priors = materialize(hosts.groupBy(F.col("host").alias("name"), "parent").agg(F.sum("s").alias("n_host"), table("s").alias("of_host")).join(parents, "parent").drop("parent"))
    if (priors.agg(F.sum(F.size("of_host") + F.size("of_parent")).alias("n")).first().n or 0) <= BROADCAST_ROWS:
        priors = F.broadcast(priors)
    out = rows.join(priors, F.col("host") == F.col("name"), "left")
    held = lambda counts, c: F.coalesce(F.element_at(counts, c), F.lit(0.0))
    n_parent, n_host = F.coalesce("n_parent", F.lit(0.0)), F.coalesce("n_host", F.lit(0.0))
    above = lambda c: (held("of_parent", c) + SMOOTHING * F.get(top, c)) / (n_parent + SMOOTHING)
    prior = lambda c: F.log((held("of_host", c) + SMOOTHING * above(c)) / (n_host + SMOOTHING))
    out = out.withColumn("fused", F.zip_with("near", "evidence", lambda c, x: x + prior(c))).withColumn("post", _normalised(F.col("fused")))
    names = F.array(*map(F.lit, classes))
    lang = F.coalesce(F.get(names, F.element_at("near", F.array_position("post", F.array_max("post")).cast("int"))), F.lit(UND))
    posterior = F.coalesce(F.array_max("post"), F.lit(1.0))
    unjudged = F.col("evidence").isNotNull() & F.coalesce(~F.col("declared").isin("", UND, *model.fitted), F.lit(False))
    return out.select("id", "th", lang.alias("lang"), posterior.alias("posterior"), "text_lang", "declared", (((lang != UND) & (posterior >= least)) | unjudged).alias("kept")).withColumnRenamed("id", doc_id)


def drop_rejected(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """The documents whose language is known, with the input's columns; only the rejected ones' keys travel."""
    b, h = free(docs, "bad", "h")
    bad = materialize(identified(docs, model, doc_id, text, **kwargs).where("not kept").select(F.col(doc_id).alias(b), F.col("th").alias(h)).distinct())
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(b)) & (F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) == F.col(h))
    return docs.join(bad, on, "left_anti")
