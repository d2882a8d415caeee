"""Sets of word shingles of whole texts, as sorted 64-bit hashes, and min-max signatures of them."""

from __future__ import annotations

from functools import cache

import numpy as np

from . import ragged

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_hashes(c: ragged.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of ``size`` words, first one of each text); a shorter text that has words is one shingle."""
    starts, ends, first = ragged.words(c)
    h = ragged.hashes(c.data, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    begin = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    left = np.minimum(np.repeat(first[1:], n) - begin, size)
    out = ragged.mix(left.astype(np.uint64) * _B)
    for k in range(size):
        some = left > k
        word = h[np.minimum(begin + k, max(len(h) - 1, 0))] if len(h) else h
        out = np.where(some, ragged.mix((out ^ word) * _A), out)
    return out, at


def sets(c: ragged.Chunk, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = shingle_hashes(c, size)
    at = at.tolist()
    return [np.unique(h[a:b]) for a, b in zip(at, at[1:], strict=False)]


@cache
def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n permutations of 32-bit integers, as columns."""
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, (n, 1), np.uint64).astype(np.uint32))


def min_max(shingle_set: np.ndarray, n: int, block: int = 1024) -> np.ndarray:
    """2 n values: the least image of the set under each of n permutations, then the greatest under each."""
    a, b = permutations(n)
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(n, 0xFFFFFFFF, np.uint32), np.zeros(n, np.uint32)
    for k in range(0, len(x), block):
        image = a * x[None, k : k + block] + b
        np.minimum(low, image.min(axis=1), out=low)
        np.maximum(high, image.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each group of ``rows`` values, which also tells the group's number."""
    v = values.reshape(-1, rows).astype(np.uint64)
    out = ragged.mix(np.arange(1, len(v) + 1, dtype=np.uint64) * _B)
    for k in range(rows):
        out = ragged.mix((out ^ v[:, k]) * _A)
    return out.view(np.int64)
