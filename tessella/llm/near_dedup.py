"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

1. A document's shingles (five words) give HASHES minima. BANDS bands of ROWS minima are its bucket keys; the low BITS
   bits of all minima, packed, are its signature. Documents with the same words are one class from here on.
2. Rows of (bucket key, class, signature) are dealt out and sorted by key. Within a bucket, signatures are compared by
   bit counts; the share of equal b-bit values, corrected for chance collisions, estimates the similarity. Pairs above a
   bound five standard deviations below the threshold stay candidates; a spanning forest of them is written, not all pairs.
   Buckets above BLOCK are split into blocks, and each pair of blocks is a piece of work of its own.
3. Components of the candidates are the units of verification: each class's text is sent once (or once for each pair of
   blocks of a large component), and all pairs inside are held against the threshold on full sets by sparse products.
4. Components of the confirmed links, joined back to classes and documents.

At the threshold a pair misses all bands with probability (1 - 0.75 ** 4) ** 32 = 5e-6.

Defined results: null or empty text and text of white space have no shingles and are linked with nothing, not even each
other; fewer than five words are one shingle; repeated rows and copies form one component; an empty table gives an
empty table; null identifiers are kept apart from all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bounded, bounded_batches, free, has_rows, materialize
from .components import components
from .textscan import text_shingles

PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(sh: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 512):
        x = low[at : at + 512, None] * _A
        x += _B
        x ^= x >> np.uint32(15)  # a product's low bits are weak; this keeps order random
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(0), out)
    return out


def keys_and_signature(m: np.ndarray) -> tuple[np.ndarray, bytes]:
    """BANDS bucket keys, and BITS low bits of every minimum as bit planes: all lowest bits, then all second ones."""
    bands = m.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = (h ^ bands[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    planes = [np.packbits((m >> np.uint32(b)) & np.uint32(1)) for b in range(BITS)]
    return h.view(np.int64), np.concatenate(planes).tobytes()


#: Documents whose words are hashed together.
_TOGETHER = 200


def plausible_share(percent: int = PERCENT) -> float:
    """Least share of equal b-bit values of a candidate: the one expected at the threshold, less five standard deviations."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return p - 5 * float(np.sqrt(p * (1 - p) / HASHES))


def similarity(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity, corrected for values that agree by chance."""
    chance = 2.0**-BITS
    return (float(_equal_shares(np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None])[0, 0]) - chance) / (1 - chance)


def _equal_shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values for each pair of signatures, by counting bits."""
    x = np.ascontiguousarray(a).view(np.uint64).reshape(len(a), BITS, -1)
    y = np.ascontiguousarray(b).view(np.uint64).reshape(len(b), BITS, -1)
    differ = np.zeros((len(a), len(b)), np.int32)
    for w in range(x.shape[2]):
        d = np.zeros((len(a), len(b)), np.uint64)
        for p in range(BITS):
            d |= x[:, p, w][:, None] ^ y[:, p, w][None, :]
        differ += np.bitwise_count(d)
    return 1 - differ / HASHES


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, n (set size), cls (16 bytes, null without words), keys and sig, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "cls", "keys", "sig"]
        for b in batches:
            for at in range(0, b.num_rows, _TOGETHER):
                part = b.slice(at, _TOGETHER)
                n, cls, keys, sig, known = [], [], [], [], {}
                for own, sh in text_shingles(part.column("text").to_pylist()):
                    if not own:
                        n.append(0), cls.append(None), keys.append(None), sig.append(None)
                        continue
                    c = xxhash.xxh3_128_digest(own)
                    if c not in known:
                        known[c] = (len(sh), *keys_and_signature(minima(sh)))
                    k = known[c]
                    n.append(k[0]), cls.append(c), keys.append(k[1].tolist()), sig.append(k[2])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=names)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return bounded_batches(rows).mapInArrow(run, "id long, n long, cls binary, keys array<long>, sig binary")


def _matched(sig: list[bytes], left: np.ndarray, right: np.ndarray, ids: np.ndarray, least: float) -> list[tuple[int, int]]:
    s = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
    out = []
    for at in range(0, len(left), BLOCK_STEP):
        rows = left[at : at + BLOCK_STEP]
        mask = _equal_shares(s[rows], s[right]) >= least
        mask &= rows[:, None] != right[None, :]
        out += S.forest(mask, rows, right, ids)
    return out


BLOCK_STEP = 256


def _bucket_links(least: float, block: int):
    """Sorted rows (key, rep, sig) -> links inside small buckets, and the rows of large ones with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sigs, blocks, seen = None, [], [], 0, None
        links: list[tuple[int, int]] = []
        hot: list[tuple[int, int, int, bytes]] = []

        def close() -> None:
            nonlocal blocks
            if blocks:
                hot.extend((key, blocks, r, s) for r, s in zip(reps, sigs))
            elif len(reps) > 1:
                every = np.arange(len(reps))
                links.extend(_matched(sigs, every, every, np.array(reps, np.int64), least))
            blocks = 0
            reps.clear(), sigs.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if links or hot:
                n, m = len(links), len(hot)
                cols = [
                    pa.array([a for a, _ in links] + [None] * m, pa.int64()), pa.array([b for _, b in links] + [None] * m, pa.int64()),
                    *[pa.array([None] * n + [h[i] for h in hot], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "block", "rep", "sig"])
            links.clear(), hot.clear()

        for batch in batches:
            for k, r, s in zip(batch.column("key").to_pylist(), batch.column("rep").to_pylist(), batch.column("sig").to_pylist()):
                if k != key:
                    if key is not None:
                        close()
                    key, seen = k, None
                if r == seen:
                    continue
                seen = r
                reps.append(r), sigs.append(s)
                if len(reps) == block:
                    hot.extend((key, blocks, a, c) for a, c in zip(reps, sigs))
                    reps.clear(), sigs.clear()
                    blocks += 1
            yield from flush()
        if key is not None:
            close()
        yield from flush()

    return run


def block_pairs(rows: DataFrame, unit: str, block: str) -> DataFrame:
    """Each row once for every pair of blocks of its unit that its block is in: x <= y, side (0: x, 1: y)."""
    n = rows.groupBy(unit).agg((F.max(block) + 1).alias("blocks"))
    out = rows.join(n, unit).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.withColumns({"x": F.least(block, "other"), "y": F.greatest(block, "other"), "side": (F.col(block) > F.col("other")).cast("int")})


#: Shingles of a block: with the rows, they bound the texts that a task compares at once.
BLOCK_SHINGLES = 1 << 20


def place(units: DataFrame, block: int) -> DataFrame:
    """component, node, n (size) -> component, node, n, x, y, side: every node once for each pair of blocks it is in.

    Blocks are dealt by hash, for a rank within a component would need all its rows in one place.
    """
    want = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("n") / F.lit(BLOCK_SHINGLES)))
    sizes = units.groupBy(F.col("component").alias("c")).agg(want.cast("long").alias("want")).where("want > 1")
    own = F.when(F.col("want").isNotNull(), F.pmod(F.xxhash64("node"), "want")).otherwise(F.lit(0)).cast("long")
    members = units.join(sizes, F.col("component") == F.col("c"), "left").select("component", "node", "n", own.alias("block"), F.coalesce("want", F.lit(1)).alias("want"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want") - 1)))
    return pairs.select("component", "node", "n", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def _paired_links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in grouped(batches, ("key", "x", "y"), ("rep", "sig", "side")):
            ids = np.array([m[0] for m in members], np.int64)
            side = np.array([m[2] for m in members])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            got = _matched([m[1] for m in members], left, right if len(right) else left, ids, least)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], take: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in `by`, from sorted batches."""
    key, members = None, []
    for b in batches:
        for k, row in zip(zip(*[b.column(c).to_pylist() for c in by]), zip(*[b.column(c).to_pylist() for c in take])):
            if k != key:
                if members:
                    yield members
                key, members = k, []
            members.append(row)
    if members:
        yield members


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in grouped(batches, ("component", "x", "y"), ("rep", "text", "side")):
            ids = np.array([m[0] for m in members], np.int64)
            sets = [sh for _, sh in text_shingles([m[1] for m in members])]
            side = np.array([m[2] for m in members])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            right = right if len(right) else left
            mask = S.linked(sets, left, right, percent) & (left[:, None] != right[None, :])
            got = S.forest(mask, left, right, ids)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = S.BLOCK) -> DataFrame:
    """Per document: the identifier, n_shingles, component_id, kept."""
    least = plausible_share(percent)
    signed = materialize(_signed(docs, doc_id, text))
    classes = signed.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("rep"))
    classes = materialize(classes)
    # keys and sig of the representative row: a row a class, found by the pair, repeated rows made one.
    reps = signed.join(classes.withColumnRenamed("cls", "c"), (F.col("cls") == F.col("c")) & (F.col("id") == F.col("rep"))).select("rep", "keys", "sig")
    posted = reps.select("rep", "sig", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "rep")
    found = materialize(posted.mapInArrow(_bucket_links(least, block), "a long, b long, key long, block long, rep long, sig binary"))
    links = found.where("a is not null").select("a", "b").distinct()
    hot = found.where("key is not null")
    if has_rows(hot):
        pairs = block_pairs(hot.select("key", "block", "rep", "sig"), "key", "block").select("key", "x", "y", "side", "rep", "sig").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        links = links.unionByName(pairs.mapInArrow(_paired_links(least), "a long, b long"))
    candidates = materialize(components(links))
    sizes = signed.select(F.col("id").alias("node"), "n").join(candidates.select("node"), "node", "left_semi").groupBy("node").agg(F.max("n").alias("n"))
    placed = place(candidates.join(sizes, "node"), block).select("component", F.col("node").alias("rep"), "x", "y", "side")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text"))
    placed = bounded(materialize(placed))
    sent = texts.join(placed, "rep")
    sent = sent.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "rep")
    confirmed = materialize(sent.mapInArrow(_verified(percent), "a long, b long"))
    groups = components(confirmed).select(F.col("node").alias("rep"), "component")
    named = classes.join(groups, "rep", "left").select(F.col("cls").alias("c"), F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "cls").join(named, F.col("cls") == F.col("c"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """One document of each group, with the input's columns; only the keys of those that go travel.

    Rows that repeat an identifier stay or go together.
    """
    (g,) = free(docs, "gone")
    gone = materialize(near_duplicates(docs, doc_id, text, **kwargs).where("not kept").select(F.col(doc_id).alias(g)).distinct())
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(g), "left_anti")


#: DuckDB: all classes of equal sets against each other by shared shingles, and what the links reach.
ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]) end as g from d),
c as (select list_sort(g) as g, min(doc_id) as c, len(any_value(g)) as n from g where len(g) > 0 group by list_sort(g)),
t as (select c, n, unnest(g) as x from c),
p as (select a.c as a, b.c as b from t a join t b using (x) where a.c <> b.c group by a.c, b.c having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r as (select a as node, a as root from p union select p.b, r.root from r join p on p.a = r.node),
m as (select node, min(root) as root from r group by node)
select g.doc_id, len(g.g)::bigint as n_shingles, coalesce(m.root, c.c, g.doc_id) as component_id, g.doc_id = coalesce(m.root, c.c, g.doc_id) as kept
from g left join c on len(g.g) > 0 and list_sort(g.g) = c.g left join m on m.node = c.c
"""
