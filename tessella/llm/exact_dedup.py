"""Exact deduplication by content sort.

Rows are range-partitioned on sampled splitters of the normalised text and sorted within each partition (external
sort), so equal texts stand next to each other; one streaming pass compares neighbours in full. The splitter key ends
in the row's length and identifier, so a group of copies that holds a third of all rows is spread over many
partitions. A group that crosses a partition's edge is put together afterwards from one summary row per partition and
edge: at most two rows a partition, which bounds what is broadcast.

Defined results: null text counts as empty; all empty texts are one group; of equal texts the one with the most code
points in its original form stays, then the smallest identifier (null identifiers last), and of rows that repeat both
exactly one; an empty table gives an empty table; columns beside text and identifier are carried whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, bounded_batches, materialize, packed

#: Code points of the normalised text in the splitter key; longer common beginnings are told apart by the hash that follows.
SPLIT_POINTS = 32


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Equal texts adjacent, the one that stays first: p, h, neg, id, norm[, text, rest]."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    cols = [F.substring(norm, 1, SPLIT_POINTS).alias("p"), F.xxhash64(norm).alias("h"), (-F.length(text)).alias("neg"), F.col(f"`{id_col}`").cast("long").alias("id")]
    cols += [F.col(f"`{text_col}`").alias("text"), packed(docs, id_col, text_col).alias("rest")] if carry else [norm.alias("norm")]
    dealt = docs.select(*cols).repartitionByRange("p", "h", "neg", F.col("id").asc_nulls_last())
    if carry:
        dealt = dealt.withColumn("norm", F.translate(F.coalesce("text", F.lit("")), BLANKS, ""))
    return dealt.sortWithinPartitions("p", "h", "norm", "neg", F.col("id").asc_nulls_last()).drop("p", "h")


def _copied(rows: pa.RecordBatch, start: int, n: int) -> pa.RecordBatch:
    """Rows of a batch in memory of their own: a slice holds on to the whole batch that came from the JVM, texts included."""
    return rows.take(pa.array(np.arange(start, start + n)))


def _runs(carry: bool, names: list[str]):
    """The pass over a sorted partition. Without carry a row for each input row, else only for the first of each run."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run: dict | None = None  # the run that isn't over yet
        opening = True  # no run has ended so far

        def out(rows: pa.RecordBatch, head_of: np.ndarray, head: np.ndarray, keep: pa.Array, neg: np.ndarray, sha: list[str], sizes: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            """rows with what is known of their runs; head_of: each row's run."""
            take = pa.array(head_of)
            cols = [rows.column(n) for n in names]
            cols += [keep.take(take), pa.array(neg[head_of], pa.int32()), pa.array(sizes[head_of], pa.int64()), pa.array(head), pa.array(sha, pa.string()).take(take), pa.array(edge[head_of]), pa.array(np.full(len(head_of), part), pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=[*names, "keep", "keep_neg", "n", "head", "sha", "edge", "part"])

        def closed(r: dict, edge: bool) -> Iterator[pa.RecordBatch]:
            first = True
            for piece in r["rows"]:
                n = piece.num_rows
                head = np.zeros(n, bool)
                head[0] = first
                yield out(piece, np.zeros(n, np.int64), head, r["keep"], r["neg"], [r["sha"]], np.array([r["n"]]), np.array([edge]))
                first = False

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            norm = b.column("norm")
            same = np.zeros(n, bool)
            same[0] = run is not None and norm[0].as_py() == run["norm"]
            if n > 1:
                same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(~same)
            first = int(starts[0]) if len(starts) else n
            slim = b.select(names)
            if first:
                run["n"] += first
                if not carry:
                    run["rows"].append(_copied(slim, 0, first))
            if not len(starts):
                continue
            if run is not None:
                yield from closed(run, opening)
                opening = False
            last = int(starts[-1])
            if last > first:
                at = starts[:-1]
                sizes = np.diff(starts)
                edge = np.zeros(len(at), bool)
                edge[0] = opening
                opening = False
                sha = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in norm.take(pa.array(at)).to_pylist()]
                keep, neg = b.column("id").take(pa.array(at)), b.column("neg").to_numpy()[at]
                if carry:
                    yield out(slim.take(pa.array(at)), np.arange(len(at)), np.ones(len(at), bool), keep, neg, sha, sizes, edge)
                else:
                    head_of = np.repeat(np.arange(len(at)), sizes)
                    yield out(slim.slice(first, last - first), head_of, ~same[first:last], keep, neg, sha, sizes, edge)
            value = norm[last].as_py()
            run = {"norm": value, "sha": hashlib.sha256(value.encode("utf-8")).hexdigest(), "keep": b.column("id").take(pa.array([last])), "neg": b.column("neg").to_numpy()[last : last + 1].copy(), "n": n - last, "rows": [_copied(slim, last, 1 if carry else n - last)]}
        if run is not None:
            yield from closed(run, True)

    return passed


def _decided(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Rows with keep_id, group_size, kept and text_sha256, groups across partition edges put together."""
    rows = _sorted(docs, id_col, text_col, carry)
    names = ["id", "text", "rest"] if carry else ["id"]
    schema = T.StructType([rows.schema[n] for n in names])
    for n, kind in (("keep", T.LongType()), ("keep_neg", T.IntegerType()), ("n", T.LongType()), ("head", T.BooleanType()), ("sha", T.StringType()), ("edge", T.BooleanType()), ("part", T.IntegerType())):
        schema = schema.add(n, kind)
    runs = materialize(bounded_batches(rows).mapInArrow(_runs(carry, names), schema))
    edges = (
        runs.where("edge and head")
        .groupBy("sha")
        .agg(F.sum("n").alias("e_n"), F.min(F.struct("keep_neg", F.col("keep").isNull().alias("none"), "keep", "part")).alias("e"))
        .select(F.col("sha").alias("e_sha"), "e_n", F.col("e.keep").alias("e_keep"), F.col("e.part").alias("e_part"))
    )
    joined = runs.join(F.broadcast(edges), F.col("edge") & (F.col("sha") == F.col("e_sha")), "left")
    return joined.select(
        *names,
        F.when(F.col("edge"), F.col("e_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(F.col("edge"), F.col("e_n")).otherwise(F.col("n")).alias("group_size"),
        (F.col("head") & (~F.col("edge") | (F.col("part") == F.col("e_part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the identifier, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    return _decided(docs, id_col, text_col, carry=False).withColumnRenamed("id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the input's columns."""
    kept = _decided(docs, id_col, text_col, carry=True).where("kept")
    named = {id_col: "id", text_col: "text"}
    return kept.select(*[(F.col(named[c]).cast(docs.schema[c].dataType) if c in named else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
