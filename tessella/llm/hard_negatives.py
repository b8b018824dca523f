"""Hard negatives by distributed radix selection over integer scores.

Rows are packed into shards of a few thousand vectors where they lie; anchors, one row in ANCHOR_EVERY, into blocks. A pass
meets every shard with every block (a join on the block's number, broadcast while the blocks are small, salted otherwise)
and scores them as matrix products in pieces; scores are never written. A window is an interval of scores of one anchor:
first that of its positives (other rows of the label), then one for each of its positives (rows of other labels from LEAST
percent of the positive's score to all of it). To find a window's kth best score, each pass counts scores by the next digit,
the counts are added up over all shards, and the bucket that holds the kth is the next, narrower interval, until a bucket is
taken whole or is one score. Then one pass gathers the rows from that score on. Of counts, a task sends only those down to
its own kth best, and of rows with equal scores its own first k by identifier: no others can be among the first k of all.

No key deals out rows: a label, a vector or a score that a third of all rows share makes no task larger. A window's counts
and rows are at most k a task.

Defined results: rows with a null identifier, label or vector, with null or non-finite components, or with a vector that is
empty or not of the most frequent length take no part; identifiers name rows, so a copy of an anchor isn't its positive and
a repeated anchor counts once if equal; other repeated rows count as often as they occur, also as positives; a positive with a
negative score has no negatives (its window is empty), nor has one without rows in its window; components beyond 2^62 after
scaling and scores beyond 2^56 stay there; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, bounded_batches, materialize
from .vectors import common_length, dense, scaled, vector_column

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256.0, 100, 7, 10
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Vectors of a shard and anchors of a block, at most (and about), and bytes of a shard.
SHARD, BLOCK, SHARD_BYTES = 8192, 1024, 4 << 20
#: Anchors that are scored against a shard at once, and bits of a digit.
PIECE, DIGIT = 128, 10
#: Bytes of counts that a task holds before it sends them on.
HELD = 96 << 20
#: Parts of the shards when blocks are too large to broadcast.
SALTS = 64
TOP = 1 << 56

_PACK = "n int, code int, most long, ids binary, labels binary, x binary"
_PACK_ARROW = pa.schema([("n", pa.int32()), ("code", pa.int32()), ("most", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])


def _packed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
    most = int(np.abs(x).max(initial=0))
    code = 2 if most < 1 << 15 else 8
    return {"n": len(ids), "code": code, "most": most, "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "x": x.astype(np.int16 if code == 2 else np.int64).tobytes()}


def _packs(dim: int, rows: int):
    """Batches of (id, label, v) -> packs of at most so many vectors, those without a whole vector left out."""
    limit = max(1, min(rows, SHARD_BYTES // (2 * dim)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            whole = [np.concatenate(c) for c in held]
            for c, w in zip(held, whole):
                c[:] = [w[limit:]]
            return pa.RecordBatch.from_pylist([_packed(*(w[:limit] for w in whole))], schema=_PACK_ARROW)

        held: tuple[list, list, list] = ([], [], [])
        for b in batches:
            at, values = dense(b.column(2), dim)
            for c, v in zip(held, (b.column(0).take(pa.array(at)).to_numpy(), b.column(1).take(pa.array(at)).to_numpy(), scaled(values, SCALE))):
                c.append(v)
            while sum(map(len, held[0])) >= limit:
                yield out()
        if sum(map(len, held[0])):
            yield out()

    return pack


def _read(b: pa.RecordBatch, i: int, prefix: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = lambda c: b.column(prefix + c)[i]
    x = np.frombuffer(at("x").as_buffer(), np.int16 if at("code").as_py() == 2 else np.int64).reshape(-1, dim)
    return np.frombuffer(at("ids").as_buffer(), np.int64), np.frombuffer(at("labels").as_buffer(), np.int64), x


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b. Doubles hold those of ordinary vectors exactly; rows with
    larger entries go through whole numbers of any size."""
    safe = int((2.0**53 / a.shape[1]) ** 0.5)
    big_a, big_b = np.abs(a).max(1) > safe, np.abs(b).max(1) > safe
    out = (a.astype(np.float64) @ b.astype(np.float64).T).clip(-TOP, TOP).astype(np.int64)
    whole = lambda x, y: np.clip(x.astype(object) @ y.astype(object).T, -TOP, TOP).astype(np.int64)
    if big_a.any():
        out[big_a] = whole(a[big_a], b)
    if big_b.any():
        out[:, big_b] = whole(a, b[big_b])
    return out


class _Windows:
    """The windows of a block as arrays: anchor x window of it; where there is none, the interval is empty."""

    def __init__(self, listed: pa.Scalar, n: int, each: int, fields: tuple[str, ...]):
        flat = listed.values
        w = flat.field("w").to_numpy()
        self.each = each
        empty = {"low": 1, "high": 0}
        for f in fields:
            a = np.full(n * each, empty.get(f, 0), np.int64)
            a[w] = flat.field(f).to_numpy()
            setattr(self, f, a.reshape(n, each))


def _scored(shard: tuple, block: tuple, win: _Windows, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Window, row of the shard and score of all that lie in a window, a piece of anchors at a time."""
    ids, labels, x = shard
    own, own_labels, ax = block
    least, most = win.low.min(1, where=win.low <= win.high, initial=TOP + 1), win.high.max(1, where=win.low <= win.high, initial=-TOP - 1)
    for p in range(0, len(own), PIECE):
        q = slice(p, p + PIECE)
        if (least[q] > most[q]).all():
            continue
        s = _product(ax[q], x)
        fits = (s >= least[q, None]) & (s <= most[q, None]) & ((own_labels[q, None] == labels) == same)
        if same:
            fits &= own[q, None] != ids
        r, c = np.nonzero(fits)
        s = s[r, c]
        r = r + p
        for j in range(win.each):
            inside = (s >= win.low[r, j]) & (s <= win.high[r, j])
            yield r[inside] * win.each + j, c[inside], s[inside]


def _first(w: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each window: higher scores first, then smaller identifiers."""
    order = np.lexsort((ids, -score, w))
    w = w[order]
    begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(begin, np.diff(np.r_[begin, len(w)]))
    return order[rank < k]


def _counter(dim: int, each: int, same: bool):
    """(shard, block, windows) -> block, w, bucket, count by the next digit, down to the task's own kth best bucket."""
    width = 1 << DIGIT

    def sent(block: int, need: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        down = counts[:, ::-1]
        before = np.cumsum(down, 1, dtype=np.int64) - down
        w, b = np.nonzero((down > 0) & (before < need[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block, np.int32)), pa.array(w), pa.array(width - 1 - b), pa.array(down[w, b].astype(np.int64))], names=["block", "w", "bucket", "count"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(len(b)):
                shard, block = _read(b, i, "", dim), _read(b, i, "a_", dim)
                win = _Windows(b.column("windows")[i], len(block[0]), each, ("low", "high", "shift", "need"))
                at = b.column("block")[i].as_py()
                if at not in held:
                    if sum(c.nbytes for _, c in held.values()) + 4 * win.low.size * width > HELD:
                        yield from (sent(k, *held.pop(k)) for k in list(held))
                    held[at] = win.need.ravel(), np.zeros((win.low.size, width), np.uint32)
                flat = held[at][1].reshape(-1)
                low, shift = win.low.ravel(), win.shift.ravel()
                for w, _, s in _scored(shard, block, win, same):
                    codes, n = np.unique(w * width + ((s - low[w]) >> shift[w]), return_counts=True)
                    flat[codes] += n.astype(np.uint32)
        yield from (sent(k, *held[k]) for k in held)

    return count


def _gatherer(dim: int, each: int, same: bool, k: int):
    """(shard, block, windows) -> block, w, anchor, id, score of the shard's first k rows of each window."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                shard, block = _read(b, i, "", dim), _read(b, i, "a_", dim)
                win = _Windows(b.column("windows")[i], len(block[0]), each, ("low", "high"))
                at = b.column("block")[i].as_py()
                for w, c, s in _scored(shard, block, win, same):
                    few = _first(w, s, shard[0][c], k)
                    w, c, s = w[few], c[few], s[few]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), at, np.int32)), pa.array(w), pa.array(block[0][w // each]), pa.array(shard[0][c]), pa.array(s)], names=["block", "w", "anchor", "id", "score"])

    return gather


class _Pass:
    """Shards and blocks, and how they meet."""

    def __init__(self, rows: DataFrame, dim: int):
        """rows: id, label, v, all whole but for entries of v."""
        self.dim = dim
        self.shards = materialize(rows.mapInArrow(_packs(dim, SHARD), _PACK))
        asked = rows.where(F.col("id") % ANCHOR_EVERY == 0).dropDuplicates()
        asked = asked.withColumn("h", F.abs(F.xxhash64("id", "label", "v") % (1 << 40)))
        n, top = asked.count(), self.shards.agg(F.max("most")).first()[0] or 0
        self.top = min(TOP, dim * int(top) ** 2)
        self.count = max(1, -(-n // BLOCK))
        pack = _packs(dim, 2 * BLOCK)

        def packs(key: tuple, group: pa.Table) -> pa.Table:
            out = pa.Table.from_batches(list(pack(iter(group.select(["id", "label", "v"]).to_batches()))), schema=_PACK_ARROW)
            return out.add_column(0, "block", pa.array([key[0].as_py()] * len(out), pa.int32()))

        dealt = asked.withColumn("block", (F.col("h") % self.count).cast("int"))
        blocks = dealt.groupBy("block").applyInArrow(packs, f"block int, {_PACK}")
        self.blocks = materialize(blocks.select(*[F.col(c).alias(c if c == "block" else f"a_{c}") for c in blocks.columns]).withColumn("block", F.col("block") * 1000 + F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("a_ids"))).cast("int") - 1))
        self.numbers = [r.block for r in self.blocks.select("block").collect()]

    def over(self, windows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        """Every shard with every block that has windows."""
        listed = windows.groupBy("block").agg(F.collect_list(F.struct("w", *fields)).alias("windows"))
        side = materialize(self.blocks.join(listed, "block"))
        shards = self.shards.withColumn("block", F.explode(F.array(*[F.lit(b) for b in self.numbers]).cast("array<int>")))
        if bounded(side) is not side:
            return shards.join(F.broadcast(side), "block")
        shards = shards.withColumn("salt", F.abs(F.xxhash64("ids") % SALTS).cast("int"))
        side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return shards.join(side, ["block", "salt"])

    def narrowed(self, windows: DataFrame, each: int, same: bool) -> DataFrame:
        """windows: block, w, low, high, need -> block, w, low, high: from the lowest score that may be among the first `need`."""
        digits = lambda width: F.greatest(F.lit(0), F.length(F.bin(width)) - DIGIT)
        ready, todo = None, windows.withColumns({"shift": digits(F.col("high") - F.col("low")), "top": F.col("high")})
        while True:
            todo = materialize(todo)
            if not todo.limit(1).count():
                break
            met = self.over(todo, ("low", "high", "shift", "need"))
            counts = met.mapInArrow(_counter(self.dim, each, same), "block int, w long, bucket long, count long").groupBy("block", "w", "bucket").agg(F.sum("count").alias("count"))
            upto = Window.partitionBy("block", "w").orderBy(F.desc("bucket"))
            counts = counts.withColumns({"upto": F.sum("count").over(upto), "place": F.row_number().over(upto)})
            # The bucket of the kth best, or else the lowest one: then all that there is belongs to the first k.
            seen = counts.join(todo, ["block", "w"]).where((F.col("upto") - F.col("count") < F.col("need")))
            seen = seen.groupBy("block", "w", "low", "high", "top", "need", "shift").agg(F.max_by(F.struct("bucket", "count", "upto"), "place").alias("b"))
            low = F.col("low") + F.expr("shiftleft(b.bucket, shift)")
            whole = (F.col("shift") == 0) | (F.col("b.upto") <= F.col("need"))
            step = materialize(
                seen.select(
                    "block", "w", low.alias("low"), F.least("high", low + F.expr("shiftleft(bigint(1), shift)") - 1).alias("high"), "top",
                    (F.col("need") - (F.col("b.upto") - F.col("b.count"))).alias("need"), F.greatest(F.lit(0), F.col("shift") - DIGIT).alias("shift"), whole.alias("whole"),
                )
            )
            done = step.where("whole").select("block", "w", "low", F.col("top").alias("high"))
            ready = done if ready is None else ready.unionByName(done)
            todo = step.where("not whole").drop("whole")
        return ready if ready is not None else windows.select("block", "w", "low", "high")

    def first(self, windows: DataFrame, each: int, same: bool, k: int) -> DataFrame:
        """block, w, anchor, id, score, rank of the first k rows of every window."""
        met = self.over(self.narrowed(windows, each, same), ("low", "high"))
        found = met.mapInArrow(_gatherer(self.dim, each, same, k), "block int, w long, anchor long, id long, score long")
        best = Window.partitionBy("block", "w").orderBy(F.desc("score"), "id")
        return materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; identifiers and labels are whole numbers."""
    given = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), vector_column(df, vector).alias("v")).dropna()
    relabelled = F.when(F.col("id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = bounded_batches(given.withColumn("label", relabelled))
    dim = common_length(rows, "v")
    empty = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not dim:
        return empty
    p = _Pass(rows, dim)
    if not p.numbers:
        return empty
    anchors = p.blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a_n").cast("long") - 1)).alias("w"))
    of_label = anchors.select("block", "w", F.lit(-p.top).alias("low"), F.lit(p.top).alias("high"), F.lit(positives).cast("long").alias("need"))
    near = p.first(of_label, 1, True, positives)
    near = near.select("block", (F.col("w") * positives + F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    low = F.expr(f"(positive_score * {least} + 99) div 100")
    asked = near.where("positive_score >= 0").select("block", "w", low.alias("low"), F.col("positive_score").alias("high"), F.lit(negatives).cast("long").alias("need"))
    far = p.first(asked, positives, False, negatives)
    out = far.join(near, ["block", "w"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB: every anchor against every row, by definition.
ORACLE_SQL = """
with g as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * c::double) as bigint) for c in embedding] as x from embeddings
where vec_id is not null and label is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
s as (select a.vec_id as a, r.vec_id as r, a.label = r.label as same, list_sum([u[1] * u[2] for u in list_zip(a.x, r.x)])::bigint as score from g a join g r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select a, r as p, score as ps from s where same qualify row_number() over (partition by a order by score desc, r) <= 5),
n as (select p.a, p.p, p.ps, s.r, s.score, row_number() over (partition by p.a, p.p order by s.score desc, s.r) as rank from p join s on s.a = p.a and not s.same and 80 * p.ps <= 100 * s.score and 100 * s.score <= 100 * p.ps)
select a as anchor_id, p as positive_id, rank::int as rank, r as negative_id, ps as positive_score, score as negative_score from n where rank <= 5
"""
