"""Words and lines of many texts at once, as numpy passes over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .shingles import WORDS, rolling

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(77)
#: A random number for each byte, and powers of an odd one, and of its inverse, for its place.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_SHORT = 32
#: Bytes that are summed at once: what a pass holds stays in the processor's cache.
_PIECE = 1 << 15


def _series(odd: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, odd, np.uint64))


_POWER, _INVERSE = _series(_ODD, 2 * _PIECE), _series(pow(_ODD, -1, 1 << 64), 2 * _PIECE)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word between [\\x20\\x09-\\x0D], and its first byte's place.

    The hash of a word of up to _SHORT bytes is a polynomial of them: a difference of running sums, freed of the word's
    place. Modulo a power of two such polynomials of long regular words meet for any base, so those have a hash of their own.
    """
    a = np.frombuffer(data, np.uint8)
    edge = np.zeros(len(a) + 2, bool)
    edge[1:-1] = ~_BLANK[a]
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(stop, base + _PIECE, "right")))
        piece = a[base : int(stop[j - 1])]
        power, inverse = (_POWER, _INVERSE) if len(piece) <= len(_POWER) else (_series(_ODD, len(piece)), _series(pow(_ODD, -1, 1 << 64), len(piece)))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * power[: len(piece)], out=total[1:])
        s = start[i:j] - base
        h[i:j] = (total[stop[i:j] - base] - total[s]) * inverse[s]
        i = j
    h ^= (stop - start).astype(np.uint64) << np.uint64(48)
    for i in np.flatnonzero(stop - start > _SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]], 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, start


def text_shingles(texts: list[str], k: int = WORDS) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of each text: its words' hashes in a row, and the distinct shingles, ascending. A-Z are lower-cased.

    Fewer words are one shingle, none are none.
    """
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    w, at = hashed_words(b"\n".join(data))
    bounds = np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in data)]))
    token = rolling(w, k) if len(w) >= k else w[:0]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = w[lo:hi].tobytes()
        if hi - lo >= k:
            yield own, np.unique(token[lo : hi - k + 1])
        else:  # the length keeps a short sequence apart from a shingle
            yield own, np.array([xxhash.xxh3_64_intdigest(own, hi - lo)] if own else [], np.uint64)


def line_tokens(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts at once: lines of each text; shingles of all lines; the line of each, ascending.

    A-Z are lower-cased. The hashes run over all words in a row; those that reach over a line's end are left out.
    """
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts if t is not None]
    lines = np.array([0 if t is None else t.count("\n") + 1 for t in texts], np.int64)
    whole = b"\n".join(data)
    w, at = hashed_words(whole)
    at = np.searchsorted(np.flatnonzero(np.frombuffer(whole, np.uint8) == 10), at)
    size = np.bincount(at, minlength=int(lines.sum())) if len(at) else np.zeros(int(lines.sum()), np.int64)
    if len(at) >= k:
        inside = at[: len(at) - k + 1] == at[k - 1 :]
        token, owner = rolling(w, k)[inside], at[: len(inside)][inside]
    else:
        token, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        first = np.cumsum(size) - size
        few = np.array([xxhash.xxh3_64_intdigest(w[first[i] : first[i] + size[i]].tobytes(), int(size[i])) for i in short], np.uint64)
        token, owner = np.concatenate([token, few]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        token, owner = token[order], owner[order]
    return lines, token, owner


def line_shingles(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts at once: lines of each text; distinct shingles of all lines, in any order; where each line's begin."""
    lines, token, owner = line_tokens(texts, k)
    total = int(lines.sum())
    # Equal neighbours among (line, token's upper bits), sorted as one number, show the few lines that may repeat a token.
    bits = np.uint64(max(1, total.bit_length()))
    near = np.sort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (token >> bits))
    again = np.unique(near[1:][near[1:] == near[:-1]] >> (np.uint64(64) - bits)).astype(np.int64)
    if len(again):
        odd = np.zeros(total, bool)
        odd[again] = True
        some = np.flatnonzero(odd[owner])
        order = some[np.lexsort((token[some], owner[some]))]
        t, o = token[order], owner[order]
        drop = order[1:][(t[1:] == t[:-1]) & (o[1:] == o[:-1])]
        keep = np.ones(len(token), bool)
        keep[drop] = False
        token, owner = token[keep], owner[keep]
    return lines, token, np.searchsorted(owner, np.arange(total + 1))
