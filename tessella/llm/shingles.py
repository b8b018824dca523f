"""Hashes of word shingles, exact Jaccard within bounded groups, and links as spanning forests."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Members of a block: two blocks are compared at once, so this bounds what a task holds and the size of its matrices.
BLOCK = 1024


def rolling(w: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of all runs of k words; w holds k words at least."""
    m = len(w) - k + 1
    h = w[:m].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[i : m + i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix left x right: 100 * intersection >= percent * union, on full sets; nothing links to an empty set."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
    token, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1  # tokens of one member alone meet nothing
    use = counts[inverse] > 1
    columns, rows = shared[inverse[use]], owner[use]
    width = int((counts > 1).sum())
    inter = np.zeros((len(left), len(right)), np.float32)
    step = max(256, 8_000_000 // max(1, len(left) + len(right)))
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(columns, [lo, lo + step])
        c, r = columns[a:b] - lo, rows[a:b]
        x = np.zeros((len(left), min(step, width - lo)), np.float32)
        y = np.zeros((len(right), min(step, width - lo)), np.float32)
        m = at_left[r] >= 0
        x[at_left[r[m]], c[m]] = 1
        m = at_right[r] >= 0
        y[at_right[r[m]], c[m]] = 1
        inter += x @ y.T
    total = sizes[left][:, None] + sizes[right][None, :] - inter
    return (inter > 0) & (100 * inter >= percent * total)


def forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of the matrix, by rows and columns in turn: one for each member reached."""
    out = []
    todo = mask.any(1)
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        rows, cols, front = np.zeros(len(left), bool), np.zeros(len(right), bool), np.array([i])
        rows[i] = True
        while len(front):
            new = mask[front].any(0) & ~cols
            cols |= new
            front = np.flatnonzero(mask[:, new].any(1) & ~rows)
            rows[front] = True
        todo &= ~rows
        root = int(ids[left[i]])
        out += [(root, int(x)) for x in np.unique(ids[np.concatenate([left[rows], right[cols]])]) if x != root]
    return out
