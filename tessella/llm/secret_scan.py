"""Secret scan over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is addressed by its SHA-256. A blob is scanned once for each rule version: pairs that the
ledger has are left out, equal blobs are put together by partial aggregation before the shuffle (a group of copies that
holds a third of all rows arrives as one row a task), and findings are joined back to every path that holds the blob.

Positions are code points, end exclusive. A pattern's matches are those of a leftmost, non-overlapping search; the text
between them comes from splitting at the same pattern, and running sums of the lengths give the positions. Texts without
any match leave after one test per pattern.

Defined results: null text counts as empty and has no findings; empty and very long texts are scanned like any other;
repeated rows and equal texts get equal findings; spans that start together are listed in the rules' order; an empty table
gives none; other columns are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, free, materialize


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int  # code points; shorter matches are dropped


#: The base rules, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so shorter ones needn't be matched to be dropped
)
#: What this version adds: the opening line of a private key in text form.
RULES = (*BASE_RULES, Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1))
RULE_VERSION = "1"


def rules_version(rules: tuple[Rule, ...], version: str = RULE_VERSION) -> str:
    """What the ledger keeps: the given version and a digest of the rules, so that other rules never pass for scanned ones."""
    return f"{version}-{hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]}"


def _may_hit(rules: tuple[Rule, ...]) -> Column:
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.col("text").rlike(r.pattern)
    return hit


def _steps(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<rank, i, gap, hit, sized>>: lengths of a rule's matches in a text and of what lies before each."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), sized.alias("sized"))
    return F.transform(steps, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), F.length(x["sized"]).alias("sized")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text -> blob, spans (start, rank, end, kind; ordered by start, then the rules' order); only blobs with spans.

    Positions are running sums over a blob's matches, sorted within the tasks that the blobs already are dealt to.
    """
    none = F.expr("cast(array() as array<struct<rank:int,i:int,gap:bigint,hit:bigint,sized:int>>)")
    steps = F.concat(*[F.when(F.col("text").rlike(r.pattern), _steps(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)])
    rows = blobs.where(_may_hit(rules)).select("blob", F.explode(steps).alias("s")).select("blob", "s.*")
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", end)
    least, kinds = F.array(*[F.lit(r.least) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    rows = rows.where(F.col("sized") >= F.get(least, F.col("rank")))
    span = F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "end", F.get(kinds, F.col("rank")).alias("kind"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_versions(versions: DataFrame, text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """versions and, as its last two columns, the address of its text and the spans (null: none). They are called blob and
    spans, with underscores before them where versions has such columns.

    ledger: a Parquet folder of blob, rule_version, spans that earlier calls have filled; scanned pairs are added to it,
    those without spans too. A pair that stands there repeatedly (of calls that ran at once, or were retried) counts once.
    """
    version = rules_version(rules, version)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blob = F.sha2(body, 256)
    b, s, other = free(versions, "blob", "spans", "found")
    addressed = versions.select("*", blob.alias(b))
    unseen = versions.select(blob.alias("blob"), body.alias("text"))
    spark = versions.sparkSession
    past = None
    if ledger is not None:
        try:
            past = spark.read.parquet(ledger).where(F.col("rule_version") == version)
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        if past is not None:
            unseen = unseen.join(past.select("blob"), "blob", "left_anti")
    # One text a blob, of those that some rule matches: partial aggregation drops a task's own copies before the shuffle.
    unique = unseen.where(_may_hit(rules)).groupBy("blob").agg(F.first("text").alias("text"))
    found = scan_blobs(unique, rules)
    if ledger is not None:
        pairs = unseen.select("blob").distinct().join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), "spans")
        new = materialize(pairs, small=True)
        new.write.mode("append").parquet(ledger)
        found = (new if past is None else past.unionByName(new)).where("spans is not null").select("blob", "spans").dropDuplicates(["blob"])
    # Few blobs have findings; where they are few enough, copies of one needn't meet in a task.
    found = bounded(materialize(found, small=True)).select(F.col("blob").alias(other), F.col("spans").alias(s))
    return addressed.join(found, F.col(b) == F.col(other), "left").drop(other)


def span_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of what scan_versions() returns."""
    base = [r.kind for r in BASE_RULES]
    spans = F.coalesce(F.col(f"`{scanned.columns[-1]}`"), F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(F.col(f"`{id_col}`").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base], F.sha2(said(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), said(spans).alias("spans"))


def oracle() -> str:
    """The same in DuckDB."""
    quoted = lambda r: "'" + r.pattern.replace("'", "''") + "'"
    each = " union all ".join(f"select doc_id, t, '{r.kind}' as kind, {i} as rank, {r.least} as least, string_split_regex(t, {quoted(r)}) as gaps, regexp_extract_all(t, {quoted(r)}) as hits, regexp_extract_all(t, {quoted(r)}, {r.group}) as sized from d" for i, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), e as ({each}),
m as (select *, unnest(generate_series(1, len(hits))) as i from e where len(hits) > 0),
p as (select doc_id, kind, rank, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as a, length(hits[i]) as n from m where length(sized[i]) >= least),
s as (select doc_id, kind, rank, a, kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint) as said from p),
g as (select doc_id, {counts}, string_agg(said, ',' order by a, rank) filter (kind in ({base})) as base, string_agg(said, ',' order by a, rank) as spans from s group by 1)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)
"""
