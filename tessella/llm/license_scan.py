"""License scan: a trained paragraph classifier, confirmed by comparison with templates, in DataFrame functions alone.

A paragraph is a line of a document or a run of neighbouring lines, of as many lines as the longest template has words:
hard-wrapped notices fit however narrow they are. Lines without a word (blank, comment marks) end a run. Its features are
the word 1- and 2-grams that occur in the licence templates (a vocabulary of fixed size, below VOCABULARY entries, so its
broadcast is bounded whatever the corpus), 2-grams across its line ends included. A softmax regression with sparse weights
is fitted on the templates, shortened and padded variants of them and plain sentences; the class "unknown" takes what isn't
a licence, and a threshold decides that is calibrated on held-out variants of the notices and held-out plain sentences:
the one with the fewest errors, which are reported with the model. A prediction is confirmed where the paragraph holds enough
of the rarer n-grams of one template of the predicted family, or all of a short one (title, SPDX tag) in hardly more words than
it has, and isn't of more lines than that template has words. A template of another family that fits better rules it out: a
notice of the Lesser GPL holds most of one of the GPL, and is none.

A finding is a shortest paragraph: none inside it is a licence of its family. Those of a family that overlap count once, at
the first one's first line; one that lies inside a longer run of another family, or goes over into one, is part of it.

The documents are read once: words are exploded and met by the broadcast vocabulary within one stage, and only
occurrences of vocabulary entries (and lines without a word) are aggregated, by document and line, with partial sets before
the shuffle. Runs are formed inside a document's row; only those starts are followed whose next lines together confirm a
template.

Fitting needs no corpus rows; it is plain gradient descent on the templates at the driver, the same in every run.

Defined results: null or empty text has no paragraph; a paragraph without a vocabulary entry is unknown; repeated rows
and equal texts get equal findings; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Usual notices by licence family.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "this project is distributed under the terms of the apache license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "bsd": (
        "released under the bsd license",
        "licensed under the 3 clause bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    ),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    "cc-by-nc-sa": ("licensed under cc by nc sa 4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license"),
    "cc-by-nc-nd": ("licensed under cc by nc nd 4.0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"),
    "agpl": (
        "released under the gnu agpl v3 license",
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
    ),
    "lgpl": (
        "released under the gnu lgpl v2.1 license",
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ),
    "isc": (
        "released under the isc license",
        "licensed under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "boost": ("distributed under the boost software license version 1.0", "licensed under the boost software license version 1.0"),
    "epl": ("licensed under the eclipse public license version 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    "eupl": ("licensed under the european union public licence version 1.2", "licensed under the eupl version 1.2"),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "released under the gnu gpl v3 license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mpl": ("licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    "proprietary": ("copyright all rights reserved no part of this work may be reproduced without prior written permission", "this document is confidential and proprietary"),
    "public-domain": ("this work is dedicated to the public domain", "this work has been released into the public domain", "cc0 1.0 universal public domain dedication"),
}
#: Titles, tags and short forms: confirmed by all of their n-grams, in a paragraph of at most SLACK words more. Parts around
#: a bar may stand apart, by APART words at most.
SHORT = {
    "agpl": ("gnu affero general public license", "gnu agpl", "spdx license identifier agpl 3.0"),
    "boost": ("boost software license", "boost software license version 1.0", "spdx license identifier bsl 1.0"),
    "cc-by-nc-nd": ("creative commons attribution noncommercial noderivatives 4.0 international", "spdx license identifier cc by nc nd 4.0"),
    "cc-by-nc-sa": ("creative commons attribution noncommercial sharealike 4.0 international", "spdx license identifier cc by nc sa 4.0"),
    "cc-by-nd": ("creative commons attribution noderivatives 4.0 international", "spdx license identifier cc by nd 4.0"),
    "epl": ("eclipse public license", "eclipse public license version 2.0", "spdx license identifier epl 2.0"),
    "eupl": ("european union public licence", "spdx license identifier eupl 1.2"),
    "isc": ("isc license", "spdx license identifier isc"),
    "lgpl": ("gnu lesser general public license", "gnu lgpl", "spdx license identifier lgpl 2.1", "spdx license identifier lgpl 3.0"),
    "proprietary": ("all rights reserved", "copyright | all rights reserved"),
    "apache": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "spdx license identifier apache 2.0"),
    "bsd": ("bsd license", "bsd 2 clause license", "bsd 3 clause license", "spdx license identifier bsd 2 clause", "spdx license identifier bsd 3 clause"),
    "cc-by": ("creative commons attribution 4.0 international", "spdx license identifier cc by 4.0"),
    "cc-by-nc": ("creative commons attribution noncommercial 4.0 international", "spdx license identifier cc by nc 4.0"),
    "cc-by-sa": ("creative commons attribution sharealike 4.0 international", "spdx license identifier cc by sa 4.0"),
    "gpl": ("gnu general public license", "gnu gpl", "spdx license identifier gpl 2.0", "spdx license identifier gpl 3.0"),
    "mit": ("mit license", "spdx license identifier mit"),
    "mpl": ("mozilla public license", "spdx license identifier mpl 2.0"),
    "public-domain": ("spdx license identifier cc0 1.0", "spdx license identifier unlicense"),
}
#: Ordinary sentences for the unknown class; every second one is held out to calibrate the threshold.
PLAIN = (
    "the river runs past the old mill and into the lake", "please write your name and address on the first page", "she released the bird under the bridge this morning",
    "the public library is open on all days of the week", "he works at mit and lives in a common house", "a copy of the letter was sent to the office",
    "this version of the program is free for any person", "the general said that the war was over", "version 2.0 of the game comes with new levels",
    "the software runs on any computer with a screen", "all of the rights were argued about in court", "a driving license was found in the street",
    "licensed plumbers work under the house", "the creative work of the artist was shown in public", "the terms of the contract are not known",
    "under the sea there is a world of its own", "the notice was included in the second edition", "permission to land was given by the tower",
    "use of the kitchen is free of charge for guests", "the apache people lived in the southwest", "the conditions on the mountain were bad",
    "the foundation was laid in the spring", "the source of the river is in the hills", "they reserved a table for four persons",
    "the file was sent along with the program", "international trade grew by a third", "in the public garden no dogs are allowed",
    "the work is done and the workers are gone", "copyright is a matter of law", "this is a test of the general system",
)
STOP = frozenset("a an and any are as at be been by for from has have his in into is it its not no of on or that the their this to was were which with you your he she they".split())
VOCABULARY = 4000
#: A template is confirmed at this share of its n-grams, one of SHORT at all of them.
CONFIRM = 0.6
#: Words that a paragraph may have beside a short template's own, and beside one of two parts.
SLACK, APART = 2, 16
#: The id of a line without a word among those of n-grams.
BLANK = -1
WORD_SPLIT = r"[^a-z0-9.]+|\.(?![0-9])"


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(WORD_SPLIT, text.lower()) if w]


def _grams(words: list[str]) -> list[str]:
    """1-grams but for stop words and single marks, and 2-grams not of stop words alone."""
    one = [w for w in words if w not in STOP and len(w) > 1]
    two = [f"{a} {b}" for a, b in zip(words, words[1:]) if not (a in STOP and b in STOP)]
    return sorted({*one, *two})


def _template_grams(text: str) -> list[str]:
    return sorted({g for part in text.split("|") for g in _grams(_words(part))})


class Template(NamedTuple):
    family: str
    grams: frozenset[int]
    need: float
    words: int
    most: int  # words of a paragraph that it may confirm


class Model(NamedTuple):
    families: tuple[str, ...]  # the last is unknown
    grams: tuple[str, ...]
    weights: np.ndarray  # gram x family
    bias: np.ndarray
    threshold: float
    templates: tuple[Template, ...]
    error: float = 0.0  # mean of the shares of held-out notices missed and of held-out plain sentences taken for one

    def probabilities(self, paragraph: str) -> np.ndarray:
        index = {g: i for i, g in enumerate(self.grams)}
        z = self.bias + sum((self.weights[index[g]] for g in _grams(_words(paragraph)) if g in index), np.zeros(len(self.families)))
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, paragraph: str) -> tuple[str, float]:
        """Family and probability, as the Spark plan has them."""
        p = self.probabilities(paragraph)
        index = {g: i for i, g in enumerate(self.grams)}
        words = _words(paragraph)
        have = {index[g] for g in _grams(words) if g in index}
        k = int(p[:-1].argmax())
        shares = [(t.family == self.families[k], len(have & t.grams) >= t.need, len(have & t.grams) / len(t.grams)) for t in self.templates if len(words) <= t.most]
        other = max((share for own, _, share in shares if not own), default=0.0)
        sure = any(own and enough and share >= other for own, enough, share in shares)
        return (self.families[k], float(p[k])) if p[k] >= self.threshold and p[k] > p[-1] and sure else ("unknown", float(p[-1]))


@functools.lru_cache(maxsize=1)
def fitted() -> Model:
    families = (*TEMPLATES, "unknown")
    rng = random.Random(7)
    texts = {f: (*ts, *SHORT.get(f, ())) for f, ts in TEMPLATES.items()}
    rows: list[tuple[list[str], int]] = []

    def varied(rng: random.Random, w: list[str], plain: tuple[str, ...], least: float) -> list[str]:
        filler = _words(rng.choice(plain))
        return filler[: rng.randrange(6)] + w[: max(4, int(len(w) * rng.uniform(least, 1)))] + filler[: rng.randrange(6)]

    for k, family in enumerate(TEMPLATES):
        for t in texts[family]:
            w = _words(t)
            rows += [(w, k)] * 3
            rows += [(varied(rng, w, PLAIN[::2], 0.7), k) for _ in range(6)]
    rows += [(_words(p), len(families) - 1) for p in PLAIN[::2] for _ in range(3)]
    template_words = sorted({w for ts in texts.values() for t in ts for w in _words(t)})
    for _ in range(200):  # licence words out of any order
        rows.append(([rng.choice(template_words) for _ in range(rng.randrange(1, 5))], len(families) - 1))
    grams = tuple(sorted({g for ts in texts.values() for t in ts for g in (*_template_grams(t), *_grams(_words(t)))}))
    assert len(grams) <= VOCABULARY
    index = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)))
    for r, (w, _) in enumerate(rows):
        x[r, [index[g] for g in _grams(w) if g in index]] = 1
    y = np.eye(len(families))[[k for _, k in rows]]
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    share = 1 / (y.sum(0) * len(families))
    weight = (y * share).sum(1, keepdims=True)
    b[-1] = 1.0  # paragraphs without features are unknown
    for _ in range(600):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y) * weight
        w -= 4.0 * (x.T @ g + 1e-4 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)  # sparse
        b[:-1] -= 4.0 * g.sum(0)[:-1]

    def template(family: str, t: str) -> Template:
        ids, n, short = frozenset(index[g] for g in _template_grams(t)), len(_words(t)), t in SHORT.get(family, ())
        return Template(family, ids, (1 if short else CONFIRM) * len(ids), n, n + (APART if "|" in t else SLACK) if short else 1 << 30)

    model = Model(families, grams, w, b, 0.0, tuple(template(f, t) for f, ts in texts.items() for t in ts))
    # Held out: other variants with other filler, titles as they are, and sentences that weren't trained on.
    rng = random.Random(8)
    notices = [(" ".join(varied(rng, _words(t), PLAIN[1::2], 0.9)) if t in TEMPLATES[f] else t.replace("|", "x 2020"), f) for f, ts in texts.items() for t in ts for _ in range(2)]
    judged = [(model.probabilities(p), model.predict(p)[0], f) for p, f in [*notices, *((p, "unknown") for p in PLAIN[1::2])]]
    n = (len(notices), len(judged) - len(notices))

    def error(threshold: float) -> float:
        said = [g if p[:-1].max() >= threshold else "unknown" for p, g, _ in judged]
        wrong = [a != f for a, (_, _, f) in zip(said, judged)]
        return (sum(wrong[: n[0]]) / n[0] + sum(wrong[n[0] :]) / n[1]) / 2

    grid = [i / 100 for i in range(30, 96)]
    least = min(map(error, grid))
    best = [t for t in grid if error(t) <= least + 1e-12]
    return model._replace(threshold=best[len(best) // 2], error=least)


def _vocabulary(spark: SparkSession, model: Model) -> DataFrame:
    """The n-grams, and the empty word that a line without one has."""
    rows = [("", BLANK), *((g, i) for i, g in enumerate(model.grams))]
    return spark.createDataFrame(rows, "gram string, gid int").withColumn("key", F.xxhash64("gram"))


def licence_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """did, th, line and last (from 0), family, probability of the paragraphs that are licences."""
    model = model or fitted()
    most = max(t.words for t in model.templates)
    vocabulary = F.broadcast(_vocabulary(docs.sparkSession, model))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("did"), F.xxhash64(body).alias("th"), F.split(F.lower(body), "\n", -1).alias("lines"))
    words = lambda p: F.split(F.trim(F.regexp_replace(p, WORD_SPLIT, " ")), " +", -1)
    # All lines' words with the next line's first one behind them, which only ends a pair.
    rows = rows.select("did", "th", F.transform("lines", words).alias("lines"))
    rows = rows.select("did", "th", F.posexplode(F.transform("lines", lambda w, i: F.array_append(w, F.coalesce(F.get(F.get("lines", i + 1), F.lit(0)), F.lit(""))))).alias("line", "w"))
    at = rows.select("did", "th", "line", "w", F.posexplode("w").alias("k", "w0")).where(F.col("k") < F.size("w") - 1)
    # One row a word and the pair it opens; a word alone is a key as well.
    over = F.col("k") == F.size("w") - 2
    keys = at.select("did", "th", "line", over.alias("over"), (F.size("w") - 1).alias("words"), F.explode(F.array("w0", F.concat_ws(" ", "w0", F.get("w", F.col("k") + 1)))).alias("g"))
    met = keys.join(vocabulary, (F.xxhash64("g") == F.col("key")) & (F.col("g") == F.col("gram")))
    # Presence, not counts; a line's own n-grams and the pair that it opens towards the next one.
    over = F.col("over") & F.contains("gram", F.lit(" "))
    lines = met.groupBy("did", "th", "line").agg(F.collect_set(F.when(~over, F.col("gid"))).alias("have"), F.collect_set(F.when(over, F.col("gid"))).alias("ahead"), F.max("words").alias("words"))
    by = lines.groupBy("did", "th").agg(F.array_sort(F.collect_list(F.struct("line", "have", "ahead", "words"))).alias("ls"))
    near = by.select("did", "th", F.explode(F.transform("ls", lambda x, i: F.slice("ls", i + 1, most))).alias("near"))
    near = near.where(~F.array_contains(F.get("near", F.lit(0))["have"], BLANK))
    # Templates and weights are literals; what is explode(array(x)) is made once a row, where a filter would repeat it.
    ints = lambda xs: F.array(*map(F.lit, xs))
    templates = F.array(*[F.struct(ints(sorted(t.grams)).alias("grams"), F.lit(float(t.need)).alias("need"), F.lit(t.words).alias("words"), F.lit(t.most).alias("most"), F.lit(model.families.index(t.family) + 1).alias("f")) for t in model.templates])
    some = lambda also: F.exists(templates, lambda t: also(t) & (F.size(F.array_intersect("have", t["grams"])) >= t["need"]))
    once = lambda df, name, x: df.select("*", F.explode(F.array(x)).alias(name))
    everything = F.array_distinct(F.flatten(F.transform("near", lambda x: F.concat(x["have"], x["ahead"]))))
    near = once(near, "have", everything).where(some(lambda t: F.lit(True)))
    runs = near.select("did", "th", F.explode(F.transform("near", lambda x, i: F.slice("near", 1, i + 1))).alias("run"))
    line, last = F.get("run", F.lit(0))["line"], F.element_at("run", -1)["line"]
    runs = runs.where((last - line < most) & ~F.exists("run", lambda x: F.array_contains(x["have"], BLANK)))
    own, ahead = F.transform("run", lambda x: x["have"]), F.transform(F.slice("run", F.lit(1), F.size("run") - 1), lambda x: x["ahead"])
    runs = once(runs.select("did", "th", line.alias("line"), last.alias("last"), F.aggregate("run", F.lit(0), lambda a, x: a + x["words"]).alias("words"), "run"), "have", F.array_distinct(F.flatten(F.concat(own, ahead)))).drop("run")
    fits = lambda t: (F.col("last") - F.col("line") < t["words"]) & (F.col("words") <= t["most"])
    runs = runs.where(some(fits))
    k = len(model.families)
    columns = F.array(*[F.struct(F.lit(float(model.bias[i])).alias("b"), F.array(*[F.lit(float(v)) for v in model.weights[:, i]]).alias("w")) for i in range(k)])
    runs = once(runs, "z", F.transform(columns, lambda c: F.aggregate("have", c["b"], lambda a, g: a + F.get(c["w"], g))))
    runs = once(runs, "e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    runs = once(runs, "p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, v: a + v)))
    own = F.slice("p", 1, k - 1)
    runs = runs.withColumn("best", F.array_max(own)).withColumn("f", F.array_position(own, F.col("best")).cast("int"))
    runs = runs.where((F.col("best") >= model.threshold) & (F.col("best") > F.col("p")[k - 1]))
    share = lambda t: F.size(F.array_intersect("have", t["grams"])) / F.size(t["grams"])
    other = lambda t: F.when((t["f"] != F.col("f")) & (F.col("words") <= t["most"]), share(t)).otherwise(0.0)
    runs = once(runs, "other", F.array_max(F.transform(templates, other)))
    runs = runs.where(some(lambda t: (t["f"] == F.col("f")) & fits(t) & (share(t) >= F.col("other"))))
    names = F.array(*map(F.lit, model.families))
    shortest = runs.groupBy("did", "th", "line", F.element_at(names, F.col("f")).alias("family")).agg(F.min(F.struct("last", F.col("best").alias("probability"))).alias("x"))
    shortest = shortest.select("did", "th", "line", "x.last", "family", "x.probability")
    order = Window.partitionBy("did", "th", "family").orderBy("line")
    inside = F.min("last").over(order.rowsBetween(1, Window.unboundedFollowing)) <= F.col("last")
    shortest = shortest.withColumn("inside", F.coalesce(inside, F.lit(False))).where("not inside").drop("inside")
    overlaps = F.lag("last").over(order) >= F.col("line")
    shortest = shortest.withColumn("overlaps", F.coalesce(overlaps, F.lit(False))).where("not overlaps").drop("overlaps")
    # A wrapped notice's first lines alone may be one of a plainer family; the run that goes on counts.
    order = Window.partitionBy("did", "th").orderBy("line", F.desc("last"))
    longer = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("last")
    goes_on = (F.lead("line").over(order) <= F.col("last")) & (F.lead("last").over(order) > F.col("last"))
    shortest = shortest.withColumn("part", F.coalesce(longer, F.lit(False)) | F.coalesce(goes_on, F.lit(False)))
    return shortest.where("not part").drop("part")


def scanned_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per document: the identifier, n_licences, families (distinct, sorted, comma-joined), paragraphs ("line:family", by line)."""
    found = licence_paragraphs(docs, doc_id, text, model)
    by = found.groupBy("did", "th").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_sort(F.collect_list(F.struct("line", "family"))).alias("ps"),
    )
    by = by.select(F.col("did").alias("fd"), F.col("th").alias("ft"), "n", "families", F.array_join(F.transform("ps", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",").alias("paragraphs"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keys = docs.select(F.col(f"`{doc_id}`").alias("did"), F.xxhash64(body).alias("th"))
    out = keys.join(by, F.col("did").cast("long").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")), "left")
    return out.select(F.col("did").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("paragraphs", F.lit("")).alias("paragraphs"))


#: DuckDB: the notices that the given tables hold, found as they are written.
ORACLE_SQL = r"""
with l as (select doc_id, unnest(range(len(x))) as line, unnest(x) as s from (select doc_id, string_split(lower(coalesce(text, '')), chr(10)) as x from documents)),
f as (select doc_id, line, case when contains(s, 'licensed under the apache license, version 2.0') then 'apache' when contains(s, 'released under the mit license') then 'mit'
when contains(s, 'licensed under the gnu general public license, version 3') then 'gpl' when contains(s, 'licensed under cc by-nc 4.0') then 'cc-by-nc' when contains(s, 'all rights reserved') then 'proprietary' end as family from l),
g as (select doc_id, count(*) as n, string_agg(distinct family, ',' order by family) as families, string_agg(line || ':' || family, ',' order by line) as paragraphs from f where family is not null group by 1)
select doc_id, coalesce(n, 0)::bigint as n_licences, coalesce(families, '') as families, coalesce(paragraphs, '') as paragraphs from documents left join g using (doc_id)
"""
