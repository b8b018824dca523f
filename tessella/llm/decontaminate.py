"""Benchmark decontamination by a prefix-filtered set join of word shingles, in DataFrame functions alone.

A window is `window` consecutive words of a benchmark item (a shorter item is one window). A document holds a window
where the same words stand in a row. A window is the ordered set of its shingles of `SHINGLE` words; a place holds the
window exactly if it holds all of its shingles at their offsets, so one necessary shingle - the rarest over all
documents - is the prefix that has to match before anything else is looked at.

1. The benchmark's shingles are counted over all documents (they are broadcast after they were counted themselves; beyond
   BROADCAST_ROWS their hashes are joined by shuffle instead). Only counts leave the tasks.
2. These order a window's shingles by rarity. The rarest one is the window's prefix; a window with a shingle that no
   document has is out.
3. A second pass meets the prefixes alone. Each place gives a start, which has to lie inside the document (positional and
   length bounds), and the words there are compared with the window's, all of them.

No text is shuffled while the windows are few enough to be broadcast. A passage that very many documents hold costs its
places, in proportion to the documents.

Defined results: null or empty text and text without word characters have no words and are clean; an item without words
has no window; repeated documents get equal results; items with equal text count separately; a null item id counts as
the string "null"; very long texts are read whole; empty tables are fine; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free, materialize

WINDOW = 10
SHINGLE = 3
#: Not part of a word: [\x00-\x2F\x3A-\x60\x7B-\x7F], A-Z being lower-cased first.
_APART = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-cased words; null and empty texts give [''] or null, which no benchmark word equals."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ", -1)


def windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """iid, ws: the windows of every item, once for each place."""
    w = F.filter(words(F.col(f"`{text}`")), lambda x: x != "")
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("iid"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return rows.select("iid", "w", F.explode(starts).alias("at")).select("iid", F.slice("w", F.col("at"), window).alias("ws"))


def _keyed(rows: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """pos and h of every run of words of one of the widths, beside the columns kept; w holds the words.

    A run over a text's end hashes like a shorter one, which costs a comparison only."""
    at = rows.select(*keep, "w", F.posexplode("w").alias("pos", "w0"))
    parts = [F.col("w0"), *[F.get("w", F.col("pos") + k) for k in range(1, max(widths))]]
    keys = [F.xxhash64(*parts[:q]) for q in widths]
    return at.select(*keep, "pos", (keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).alias("h"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, th (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("did"), F.xxhash64(t).alias("th"), t.alias("text"))

    by_item = materialize(windows(items, item_id, item_text, window).distinct())
    distinct = by_item.select("ws").distinct().select(F.xxhash64("ws").alias("wid"), F.xxhash64(F.lit(1), "ws").alias("wid2"), "ws", F.least(F.lit(SHINGLE), F.size("ws")).alias("q"))
    parts = distinct.select("wid", "wid2", "ws", "q", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("q"))).alias("off"))
    spelt = F.expr("case q when 1 then xxhash64(ws[off]) when 2 then xxhash64(ws[off], ws[off + 1]) else xxhash64(ws[off], ws[off + 1], ws[off + 2]) end")
    parts = materialize(parts.withColumn("h", spelt))
    small = parts.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    widths = sorted(r.q for r in parts.select("q").distinct().collect())  # at most SHINGLE values
    if not widths:
        found = rows.select("did", "th").where("false").withColumns({"n_hit": F.lit(0), "n_items": F.lit(0), "ids": F.array(F.lit(""))})
    else:
        split = rows.select("did", "th", words(F.col("text")).alias("w"))
        met = _keyed(split, widths).join(hint(parts.select("h").distinct()), "h")
        counts = materialize(met.groupBy("h").agg(F.count("*").alias("n")))
        ranked = parts.join(counts, "h").groupBy("wid", "wid2").agg(F.min(F.struct("n", "h", "off")).alias("m"), F.count("*").alias("have"), F.min("q").alias("q"), F.min("ws").alias("ws"))
        prefixes = materialize(ranked.where("have = size(ws) - q + 1").select("wid", "wid2", "ws", F.col("m.h").alias("ph"), F.col("m.off").alias("off")))
        start = F.col("pos") - F.col("off")
        if small:
            places = _keyed(split, widths, "did", "th", "w").join(F.broadcast(prefixes), F.col("h") == F.col("ph"))
            places = places.select("did", "th", "w", "wid", "wid2", "ws", start.alias("start"))
        else:
            places = _keyed(split, widths, "did", "th").join(prefixes, F.col("h") == F.col("ph")).select(F.col("did").alias("d2"), F.col("th").alias("t2"), "wid", "wid2", "ws", start.alias("start")).where("start >= 0")
            places = split.join(places, F.col("did").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
        held = places.where("start >= 0 and start + size(ws) <= size(w)").where(F.slice("w", F.col("start") + 1, F.size("ws")) == F.col("ws"))
        hits = materialize(held.select("did", "th", "wid", "wid2", F.size("ws").alias("len"), "start").distinct())
        covered = hits.select("did", "th", F.explode(F.expr("sequence(start, start + len - 1)")).alias("p")).distinct().groupBy("did", "th").agg(F.count("*").alias("n_hit"))
        ids = by_item.select(F.xxhash64("ws").alias("wid"), F.xxhash64(F.lit(1), "ws").alias("wid2"), "iid")
        whose = hits.select("did", "th", "wid", "wid2").distinct().join(ids, ["wid", "wid2"]).select("did", "th", "iid").distinct().groupBy("did", "th").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("iid")).alias("ids"))
        w2 = whose.withColumnsRenamed({"did": "d3", "th": "t3"})
        found = covered.join(w2, F.col("did").eqNullSafe(F.col("d3")) & (F.col("th") == F.col("t3"))).select("did", "th", "n_hit", "n_items", "ids")
    found = found.withColumnsRenamed({"did": "fd", "th": "ft"})
    all_docs = rows.select("did", "th", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    out = all_docs.join(found, F.col("did").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("did").alias("doc_id"), "th", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """The documents that hold no window of any item, with the input's columns. Only the keys of contaminated ones are shuffled with them."""
    b, h = free(docs, "bad", "h")
    bad = contamination(docs, items, doc_id, text, **kwargs).where("contaminated").select(F.col("doc_id").alias(b), F.col("th").alias(h)).distinct()
    bad = materialize(bad)
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(b)) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col(h))
    return docs.join(bad, on, "left_anti")


ORACLE_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, w[i:i + least(10, len(w)) - 1] as ws from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from iw where len(w) > 0)),
lens as (select distinct len(ws) as n from win),
pos as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from dw, lens where len(w) >= n),
hit as (select p.doc_id, p.i, p.n, win.item_id from pos p join win on p.w[p.i:p.i + p.n - 1] = win.ws),
cov as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from hit) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by 1)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join cov using (doc_id) left join its using (doc_id)
"""
