"""URL filter: longest-match rules first, then link-graph propagation for what no rule fits.

Hosts are nodes; a page's links to other hosts are edges (distinct host pairs; relative links stay on their host). Trust is
personalised PageRank from hosts of whose pages rules allow at least SEED; distrust runs over reversed edges from hosts of
whose pages rules block at least SEED, so a host that links to blocked ones is distrusted. A seed's weight is that share.
Both walks are distributions: what reaches a host without links goes back to the seeds, and rounds go on until they change
less than TOLERANCE. Scores are ranks in units of a seed of weight one, so they don't shrink as the web grows. A host is
blocked where its distrust is at least FLOOR and at least RELATIVE of its trust and distrust together.

Counts by host and the edges are pre-aggregated before each shuffle, so a host with a third of all pages is a row a task;
edges are written once in buckets by their source, so a round moves ranks to them and sums by target, but moves no edges. A
source with more than HUB edges has them in several parts.

Defined results: a null url or one without '://' has empty host and path, no rule and no links, and is allowed; a null
html has no links; of rules of equal length the first one listed wins; repeated rows are judged alike; very long urls and
pages are read whole; without a seed host nothing is trusted or distrusted; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, bucketed, has_rows, materialize

DAMPING, TOLERANCE = 0.85, 1e-4
SEED, FLOOR, RELATIVE = 0.5, 0.01, 0.5
#: At DAMPING the walk has changed by less than 1e-7 after so many rounds.
MAX_ROUNDS = 100
#: Rounds between two looks at the change.
LOOK_EVERY = 4
#: Arcs of a bucket (a session that runs more tasks at once has more buckets), and of one part of a host's.
BUCKET_ARCS, HUB = 1 << 23, 1 << 16
#: Rounds that the SQL writes out; exact where there are no arcs, as in the test data.
SQL_ROUNDS = 8
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


class UrlRule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, null where none fits; rules is a short list."""
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    ordered = sorted(rules, key=lambda r: -len(r.name))
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered])


def _laid(arcs: DataFrame, out: DataFrame) -> DataFrame:
    """kind, src, part, dst: the arcs in buckets by what a round asks for, written once; a hub's arcs are dealt over its parts."""
    hubs = out.where("parts > 1").select("kind", F.col("host").alias("src"), "parts")
    if has_rows(hubs):
        arcs = arcs.join(bounded(hubs), ["kind", "src"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int"))
    else:
        arcs = arcs.withColumn("part", F.lit(0))
    n = max(arcs.sparkSession.sparkContext.defaultParallelism, -(-out.agg(F.sum("n")).first()[0] // BUCKET_ARCS))
    return bucketed(arcs.select("kind", "src", "part", "dst"), ("kind", "src", "part"), n)


def _moved(state: DataFrame, laid: DataFrame) -> DataFrame:
    """kind, host, rank: what every arc takes along. Only hosts with arcs are exchanged; the arcs stay in their buckets, unsorted."""
    told = state.where("w is not null").select("kind", F.col("host").alias("src"), (F.col("rank") * F.col("w")).alias("rank"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return told.hint("shuffle_hash").join(laid, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), "rank")


def propagate(arcs: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """arcs: kind, src, dst (distinct); seeds: kind, host, weight -> kind, host, rank: for each kind a distribution.

    A round's sums of what hosts with arcs hold (one number a kind) are all that reaches the driver. Hosts may be of any type.
    """
    totals = {r.kind: r.w for r in seeds.groupBy("kind").agg(F.sum("weight").alias("w")).collect()}
    kinds = list(totals)
    by_kind = lambda values: F.coalesce(*[F.when(F.col("kind") == kinds.index(k), F.lit(float(v))) for k, v in values.items()], F.lit(0.0))
    code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(None)).cast("byte").alias("kind")
    named = lambda df: df.select(F.coalesce(*[F.when(F.col("kind") == i, F.lit(k)) for i, k in enumerate(kinds)], F.lit(None)).cast(seeds.schema["kind"].dataType).alias("kind"), "host", "rank")
    restart = seeds.select(code, "host", "weight").select("kind", "host", (F.col("weight") * by_kind({k: 1 / w for k, w in totals.items() if w})).alias("rank"))
    restart = materialize(restart)
    arcs = materialize(arcs.select(code, "src", "dst").where("kind is not null and src is not null"))
    if not has_rows(arcs):
        return named(restart)
    out = arcs.groupBy("kind", F.col("src").alias("host")).agg(F.count("*").alias("n"))
    out = materialize(out.select("*", (F.lit(damping) / F.col("n")).alias("w"), F.ceil(F.col("n") / HUB).cast("int").alias("parts")))
    laid, links = _laid(arcs, out), out.drop("n")
    linked = lambda df: materialize(df.join(links, ["kind", "host"], "left"))
    state = seen = linked(restart)
    for k in range(1, rounds + 1):
        sent = {r.kind: r.s * damping for r in state.where("w is not null").groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
        back = restart.select("kind", "host", (F.col("rank") * by_kind({kind: 1 - sent.get(i, 0.0) for i, kind in enumerate(kinds)})).alias("rank"))
        state = linked(_moved(state, laid).unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        if k % LOOK_EVERY == 0:
            both = state.select("kind", "host", "rank").unionByName(seen.select("kind", "host", (-F.col("rank")).alias("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d"))
            if max((r.d for r in both.groupBy("kind").agg(F.sum("d").alias("d")).collect()), default=0.0) <= tolerance:
                break
            seen = state
    return named(state)


def judged_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    shares = (
        rows.where("host <> ''")
        .groupBy("host")
        .agg(F.avg(F.when(F.col("r.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("r.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    )
    seeds = materialize(shares.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, weight)")).where(F.col("weight") >= SEED))
    links = pages.select(host_of(u).alias("a"), F.explode(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(LINK), F.lit(1))).alias("b")).select("a", ascii_lower(F.col("b")).alias("b")).where("a <> '' and a <> b").distinct()
    arcs = links.select(F.expr("stack(2, 'trust', a, b, 'distrust', b, a) as (kind, src, dst)"))
    units = {r.kind: r.w for r in seeds.groupBy("kind").agg(F.sum("weight").alias("w")).collect()}
    ranks = propagate(arcs, seeds)
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank") * units.get(kind, 0.0)).otherwise(0.0)).alias(kind)
    wide = ranks.groupBy("host").agg(score("trust"), score("distrust"))
    wide = wide.withColumn("bad", (F.col("distrust") >= FLOOR) & (F.col("distrust") >= RELATIVE * (F.col("trust") + F.col("distrust"))))
    out = rows.join(bounded(materialize(wide)), "host", "left")
    return out.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def walk_sql(rounds: int, damping: float = DAMPING) -> str:
    """DuckDB: tables seeds (kind, host, weight) and arcs (kind, src, dst) -> s0 ... s<rounds> (kind, host, rank)."""
    first = f"units as (select kind, sum(weight) as u from seeds group by 1), s0 as (select kind, host, weight / u as rank from seeds join units using (kind)), degrees as (select *, {damping!r} / count(*) over (partition by kind, src) as w from arcs)"
    step = ", m{1} as (select a.kind, a.dst as host, sum(s.rank * a.w) as rank from s{0} s join degrees a on a.kind = s.kind and a.src = s.host group by 1, 2), s{1} as (select kind, host, sum(rank) as rank from (select * from m{1} union all select s0.kind, s0.host, s0.rank * (1 - coalesce(t.t, 0)) from s0 left join (select kind, sum(rank) as t from m{1} group by 1) t on t.kind = s0.kind) group by 1, 2)"
    return first + "".join(step.format(k, k + 1) for k in range(rounds))


def oracle() -> str:
    """The same in DuckDB, so many rounds written out."""
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for r in ordered) + " end"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    host = low("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    quoted = LINK.replace("'", "''")
    return f"""
with base as (select page_id, html, {host} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rows_ as (select page_id, html, host, path, {case(lambda r: r.name)} as rule, {case(lambda r: r.verdict)} as said from base),
shares as (select host, avg(case when said = 'allow' then 1.0 else 0.0 end) as t, avg(case when said = 'block' then 1.0 else 0.0 end) as d from rows_ where host <> '' group by 1),
seeds as (select 'trust' as kind, host, t as weight from shares where t >= {SEED!r} union all select 'distrust', host, d from shares where d >= {SEED!r}),
l as (select distinct host as a, {low("b")} as b from (select host, unnest(regexp_extract_all(html, '{quoted}', 1)) as b from rows_) where host <> '' and host <> {low("b")}),
arcs as (select 'trust' as kind, a as src, b as dst from l union all select 'distrust', b, a from l), {walk_sql(SQL_ROUNDS)},
wide as (select host, sum(case when kind = 'trust' then rank * u else 0 end) as t, sum(case when kind = 'distrust' then rank * u else 0 end) as d from s{SQL_ROUNDS} join units using (kind) group by 1)
select page_id, host, path, rule, coalesce(said, case when d >= {FLOOR!r} and d >= {RELATIVE!r} * (t + d) then 'block' end, 'allow') as verdict from rows_ left join wide using (host)
"""
