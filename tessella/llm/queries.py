"""The registered queries of the corpus operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, license_scan, line_dedup, near_dedup, page_text, secret_scan, url_filter
from .common import shared_dir
from .chat_format import chat_examples, conversation_digests
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .language_id import fit, identified
from .license_scan import scanned_licences
from .line_dedup import duplicate_lines
from .near_dedup import near_duplicates
from .packing import packed_documents
from .secret_scan import scan_versions, span_digests
from .url_filter import host_of, judged_urls
from .whitening import whitened_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identified(docs, fit(docs), declared="lang").drop("th")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's walk over real arcs: customers link to the parts they order; trust starts at well-filled accounts, distrust
    runs back from dear parts. Six rounds, as the SQL writes them out. On the way, even hosts are customers and odd ones parts."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    customer, part = (lambda key: F.col(key).cast("long") * 2), (lambda key: F.col(key).cast("long") * 2 + 1)
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(customer("o_custkey").alias("a"), part("l_partkey").alias("b")).distinct()
    arcs = pairs.select(F.expr("stack(2, 'trust', a, b, 'distrust', b, a) as (kind, src, dst)"))
    rich = _table(spark, sf_dir, "customer").where("c_acctbal >= 5000").select(F.lit("trust").alias("kind"), customer("c_custkey").alias("host"))
    dear = _table(spark, sf_dir, "part").where("p_retailprice >= 950").select(F.lit("distrust").alias("kind"), part("p_partkey").alias("host"))
    seeds = rich.unionByName(dear).withColumn("weight", F.lit(1.0))
    named = F.concat(F.when(F.col("host") % 2 == 0, "c").otherwise("p"), F.shiftright("host", 1))
    return url_filter.propagate(arcs, seeds, tolerance=0.0, rounds=6).select("kind", named.alias("host"), F.round("rank", 9).alias("rank"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's operator over pages, with the models of documents: here the markup's lang attribute, the host's suffix and
    the host's parents are the evidence beside the text."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), host_of(F.col("url")).alias("host"))
    return identified(pages, fit(_table(spark, sf_dir, "documents")), doc_id="page_id", host="host").drop("th")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first scans every blob, the second finds all of them in the ledger and scans none."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/ledger/{uuid.uuid4().hex}"
    scan_versions(docs, ledger=ledger)
    return span_digests(scan_versions(docs, ledger=ledger))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents")).drop("ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


#: A conversation whose texts hold the template's own control strings.
PROBE = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select bigint(-7) as conv_id, bigint(turn) as turn, role, :text as text from values (0, 'user'), (1, 'assistant') as t(turn, role)", args={"text": PROBE})
    return conversation_digests(chat_examples(turns.unionByName(probe)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicate_lines(_table(spark, sf_dir, "documents"))
    return out.select(F.col("did").alias("doc_id"), "class_id", "n_lines", "n_links", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_licences(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(_table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_near_dedup, op4_secret_scan, op5_packing, op6_decontamination, op7_chat_format, op8_line_dedup, op9_license_scan, op10_exact_dedup, op11_embedding_whitening, op12_html_extraction, op13_hard_negatives, url_propagation, language_id_pages)}


SQL = {
    "op2_url_filter": url_filter.oracle(),
    "url_propagation": f"""
with pairs as (select distinct 'c' || o_custkey as a, 'p' || l_partkey as b from lineitem join orders on l_orderkey = o_orderkey),
arcs as (select 'trust' as kind, a as src, b as dst from pairs union all select 'distrust', b, a from pairs),
seeds as (select 'trust' as kind, 'c' || c_custkey as host, 1.0::double as weight from customer where c_acctbal >= 5000 union all select 'distrust', 'p' || p_partkey, 1.0 from part where p_retailprice >= 950),
{url_filter.walk_sql(6)} select kind, host, round(rank, 9) as rank from s6
""",
    "op3_near_dedup": near_dedup.ORACLE_SQL,
    "op4_secret_scan": secret_scan.oracle(),
    "op6_decontamination": decontaminate.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op12_html_extraction": page_text.ORACLE_SQL,
    "op9_license_scan": license_scan.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    "op7_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
w as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from c),
e as (select *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ': ' || replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') || chr(60) || '/turn>' || chr(10) as s from w),
r as (select *, sum(length(s)) over (partition by conv_id order by k) as upto, k = max(k) over (partition by conv_id) as is_last from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
cast(sum(upto) filter (role = 'assistant' or is_last) as bigint) as formatted_chars from r group by conv_id
""",
    "op10_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
r as (select *, row_number() over (partition by norm order by length(t) desc, doc_id nulls last) as k from d)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, k = 1 as kept, sha256(norm) as text_sha256
from r window w as (partition by norm order by k rows between unbounded preceding and unbounded following)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
