"""Sequence packing by vector bin packing with the dot-product heuristic.

Items (tokenised documents or instruction examples) are placed into sequences under three limits at once: tokens,
segments and loss-bearing tokens. The open sequence takes, among the items that fit, the one whose demand has the
largest dot product with what is left of each limit (all as shares of the limits). Plain documents may be cut: when
nothing fits any more and more than SLACK tokens are left, the largest cuttable item gives the missing piece, and the
last sequence of a partition is split into powers of two, which need no padding. Instruction examples stay whole.

Each task tokenises and packs its own partition in windows of WINDOW_TOKENS: no shuffle, bounded memory, and a retried
task gives the same sequences. A sequence's id holds the partition, so ids are unique without a global step.

Defined results: a null or empty text is a document of its end token alone; an item longer than the token limit is cut
at the limit even if it should stay whole; an item whose loss-bearing tokens alone exceed their limit gets a sequence
of its own; repeated rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

CAPACITY, SEGMENTS, SLACK = 2048, 256, 16
WINDOW_TOKENS = 4_000_000
END_ID = 1
#: Words that a worker's cache takes before it starts anew; what is met again moves over from the one before.
CACHE = 150_000
#: Rows and bytes of text that are encoded together, new words that the tokenizer gets as one text.
_TOGETHER, _TOGETHER_BYTES, _JOINED = 1000, 1 << 22, 5000
#: White space and word classes of Latin-1 as the tokenizer's own pattern has them, for texts without other characters.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \t\n\x0b\x0c\r\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: The same over several runs, whose ends stay as blanks.
_LATIN_RUNS = re.compile(_LATIN.pattern + "| ")
#: Latin-1 in lower case, with a blank for all that the tokenizer takes for white space.
_FOLDED = np.array([ord(" ") if chr(c) in "\t\n\x0b\x0c\r\x85\xa0" else ord(chr(c).lower()) for c in range(256)], np.uint8)
#: Texts that tell whether a tokenizer treats Latin-1 texts as _FOLDED and _LATIN do.
_PROBES = ("It's A test\x85of 12\xbd \xdcber-Stra\xdfe \xb5m, caf\xe9! a_b \x1c\xa0x\n\n'll '' 'Re <x>", "Hello World", "HELLO wORLD'S", "a  b\tc ", "x-y.z 2024 $$$ \xc9T\xc9")
_BYTES = pa.large_binary()
_TOKENIZERS: dict = {}


class Limits(NamedTuple):
    tokens: int = CAPACITY
    segments: int = SEGMENTS
    loss: int = CAPACITY


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class _Encoder:
    """A word-level tokenizer with a cache: the ids of a text are those of its words in a row, so also those of its runs
    between white space, each a word or several. A blank, the end of a run, has no ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {" ": b""}
        self.before: dict[str, bytes] = {}
        spec = json.loads(self.whole.to_str())
        # The strings of added tokens stand for themselves wherever they are; texts that hold one are encoded whole.
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.whole.get_vocab(with_added_tokens=False)
        #: By id: this token ends a word. Null: words can't be told apart within one text.
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        # Words can be looked up one by one only if that gives the same ids as whole texts, in their own case.
        self.by_word = False
        self.by_word = self._looked_up([p.encode("latin-1") for p in _PROBES]) == [self._bytes(self._ids(p)) for p in _PROBES]
        self.cache = {" ": b""}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), _JOINED):
            part = new[at : at + _JOINED]
            if self.ends is not None:
                ids = np.asarray(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) == len(part):
                    self.cache.update(zip(part, self._cut(ids.tobytes(), 4 * stop)))
                    continue
            for w, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[w] = self._bytes(e.ids)

    @staticmethod
    def _cut(data: bytes, stops: np.ndarray) -> list[bytes]:
        stops = stops.tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _words_ids(self, words: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.before, self.cache = self.cache, {" ": b""}
        new = set(words).difference(self.cache)
        if self.before:
            known = [w for w in new if w in self.before]
            self.cache.update((w, self.before[w]) for w in known)
            new.difference_update(known)
        self._learn(list(new))
        return list(map(self.cache.__getitem__, words))

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        """The ids of Latin-1 texts: cut after blanks, each different run's words looked up, the ids gathered in the runs' order."""
        if not texts:
            return []
        data = _FOLDED[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        ends = np.flatnonzero(data == 32) + 1
        runs = pa.Array.from_buffers(_BYTES, len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)]).dictionary_encode()
        # The different runs lie one after another, so that their words can be found in one text.
        *_, own, different = runs.dictionary.buffers()
        found = _LATIN_RUNS.findall(str(different.slice(0, int(np.frombuffer(own, np.int64)[len(runs.dictionary)])), "latin-1"))
        ids = self._words_ids(found)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        blank = sizes == 0
        if blank.sum() != len(runs.dictionary):  # words without ids
            blank = np.fromiter((w == " " for w in found), bool, len(found))
        stops = np.cumsum(sizes)[blank]
        every = pa.Array.from_buffers(_BYTES, len(stops), [None, pa.py_buffer(np.concatenate([[0], stops])), pa.py_buffer(b"".join(ids))]).take(runs.indices)
        upto = np.frombuffer(every.buffers()[1], np.int64)
        last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts])) + 1
        return self._cut(every.buffers()[2].to_pybytes(), upto[last])

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[tuple[int, bytes]] = []
        for k, t in enumerate(texts):
            low = t.lower()
            if self.by_word and (data := _latin(t)) is not None and not any(x in low for x in self.added):
                plain.append((k, data))
            else:
                out[k] = self._bytes(self._ids(t))
        for (k, _), data in zip(plain, self._looked_up([data for _, data in plain])):
            out[k] = data
        return out


def encoder(path: str) -> _Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Encoder(path)
    return _TOKENIZERS[path]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most _TOGETHER rows and about _TOGETHER_BYTES, or a row."""
    sizes = pc.binary_length(b.column("text")).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start == _TOGETHER or held + n > _TOGETHER_BYTES):
            yield b.slice(start, k - start)
            start, held = k, 0
        held += n
    if sizes:
        yield b.slice(start)


def _encoded(path: str, end_id: int | None):
    """Batches of id and text -> of id, ids, loss and whole."""
    end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for part in _slices(b):
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.nulls(part.num_rows, pa.int64()), pa.array(np.zeros(part.num_rows, bool))], names=["id", "ids", "loss", "whole"])
        if len(enc.cache) + len(enc.before) > CACHE:
            enc.before = {}  # a worker that waits for its next task holds one generation

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return bounded_batches(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """id, ids (little-endian unsigned 32-bit, with the end token), loss (null: every token), whole (false: may be cut)."""
    return _rows(docs, doc_id, text).mapInArrow(_encoded(tokenizer or _default_path(), end_id), "id long, ids binary, loss long, whole boolean")


def _sequence(pool: _Pool, limits: Limits, cut: bool) -> list[tuple[int, int, int]]:
    left = [limits.tokens, limits.segments, limits.loss]
    placed = []
    while left[0] and left[1]:
        k = pool.best(left, limits)
        if k is not None:
            item, start, n, loss = pool.take(k)
        elif cut and left[0] > SLACK and left[2] > 0 and (got := pool.cut(min(left[0], left[2]))):
            item, start, n, loss = got
        else:
            break
        placed.append((item, start, n))
        left = [left[0] - n, left[1] - 1, left[2] - loss]
    return placed


class _Pool:
    """Items by (tokens, loss, whole): as many kinds as there are sizes."""

    def __init__(self):
        self.key: dict[tuple[int, int, bool], int] = {}
        self.items: list[list[tuple[int, int]]] = []
        self.room = 0
        self.t = self.loss = self.open = self.soft = np.zeros(0)
        self.size = 0
        self.tokens = 0

    def add(self, item: int, start: int, n: int, loss: int, whole: bool) -> None:
        k = self.key.get((n, loss, whole))
        if k is None:
            k = self.key[(n, loss, whole)] = len(self.items)
            self.items.append([])
            if k >= self.room:
                self.room = max(256, 2 * self.room)
                for name in ("t", "loss", "open", "soft"):
                    old = getattr(self, name)
                    new = np.zeros(self.room)
                    new[: len(old)] = old
                    setattr(self, name, new)
            self.t[k], self.loss[k], self.soft[k] = n, loss, not whole
        self.items[k].append((item, start))
        self.open[k] = 1
        self.size += 1
        self.tokens += n

    def best(self, left: list[int], limits: Limits) -> int | None:
        m = len(self.items)
        if not self.size:
            return None
        t, loss = self.t[:m], self.loss[:m]
        score = t * (left[0] / limits.tokens**2) + loss * (left[2] / limits.loss**2) + left[1] / limits.segments**2
        score[(self.open[:m] == 0) | (t > left[0]) | (loss > left[2])] = -1
        k = int(score.argmax())
        return k if score[k] >= 0 else None

    def take(self, k: int) -> tuple[int, int, int, int]:
        item, start = self.items[k].pop()
        if not self.items[k]:
            self.open[k] = 0
        self.size -= 1
        n = int(self.t[k])
        self.tokens -= n
        return item, start, n, int(self.loss[k])

    def cut(self, n: int) -> tuple[int, int, int, int] | None:
        """The first n tokens of the largest item that may be cut; what is left of it goes back."""
        m = len(self.items)
        size = self.t[:m] * self.open[:m] * self.soft[:m]
        if not m or size.max() <= n:
            return None
        item, start, whole, _ = self.take(int(size.argmax()))
        self.add(item, start + n, whole - n, whole - n, False)
        return item, start, n, n


def _placed(limits: Limits, window_tokens: int):
    """Batches of items -> batches of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq = part << 40
        pool = _Pool()
        ids: list = []  # of the window's items: (id, ids)
        rows: list[tuple] = []

        def write(placed: list[tuple[int, int, int]]) -> None:
            nonlocal seq
            at = 0
            for item, start, n in placed:
                key, data = ids[item]
                rows.append((key, start, n, data[4 * start : 4 * (start + n)], len(data) // 4, seq, at))
                at += n
            seq += 1

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 5000):
                cols = list(zip(*rows[at : at + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()

        def drain(last: bool) -> Iterator[pa.RecordBatch]:
            """Pack what the window holds; before the last one, stop when less than a sequence is left over."""
            nonlocal ids, pool
            while pool.size and (last or pool.tokens >= 4 * limits.tokens):
                placed = _sequence(pool, limits, cut=True)
                if not placed:  # its loss alone is over the limit
                    m = len(pool.items)
                    placed = [pool.take(int((pool.t[:m] * pool.open[:m]).argmax()))[:3]]
                total = sum(n for *_, n in placed)
                if last and not pool.size and total < limits.tokens and not any(whole[i] for i, *_ in placed):
                    for bit in reversed(range(total.bit_length())):
                        if total >> bit & 1:
                            part_, room = [], 1 << bit
                            while room:
                                item, start, n = placed[0]
                                k = min(n, room)
                                part_.append((item, start, k))
                                room -= k
                                placed[0] = (item, start + k, n - k)
                                if n == k:
                                    placed.pop(0)
                            write(part_)
                else:
                    write(placed)
            yield from flush()
            kept = [(k, *x) for k, own in enumerate(pool.items) for x in own]
            old, pool_, flags = ids, pool, list(whole)
            ids, pool = [], _Pool()
            whole.clear()
            sizes = {k: key for key, k in pool_.key.items()}
            for k, item, start in kept:
                n, loss, w = sizes[k]
                ids.append(old[item])
                whole.append(flags[item])
                pool.add(len(ids) - 1, start, n, loss, w)

        whole: list[bool] = []
        held = 0
        for b in batches:
            for key, data, loss, stays in zip(*[b.column(c).to_pylist() for c in ("id", "ids", "loss", "whole")]):
                n, start = len(data) // 4, 0
                ids.append((key, data))
                stays = bool(stays) and loss is not None
                whole.append(stays)
                while n - start > limits.tokens or (n - start == limits.tokens and loss is None):
                    write([(len(ids) - 1, start, limits.tokens)])
                    start += limits.tokens
                if n > start:
                    pool.add(len(ids) - 1, start, n - start, n - start if loss is None else min(loss, n - start), stays)
                held += n
                if held >= window_tokens:
                    yield from drain(False)
                    held = 0
        yield from drain(True)

    return run


PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed_sequences(tokens: DataFrame, limits: Limits = Limits(), window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces: id, start, length, ids, doc_tokens, sequence_id, offset, of the rows of tokenized() or alike."""
    return tokens.mapInArrow(_placed(limits, window_tokens), PIECES)


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, limits: Limits = Limits(segments=CAPACITY)) -> DataFrame:
    """The contract's columns and the ids of every piece. By itself the number of pieces in a sequence of documents has no limit."""
    encode, place = _encoded(tokenizer or _default_path(), END_ID), _placed(limits, WINDOW_TOKENS)
    out = _rows(docs, doc_id, text).mapInArrow(lambda batches: place(encode(batches)), PIECES)  # one Python worker a task
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
