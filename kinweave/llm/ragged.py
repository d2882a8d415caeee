"""Whole texts as ragged byte arrays: chunks of an Arrow batch, words, hashes, interned segments.

All of it is exact on whole texts; the chunk budget bounds memory, never what is read. A text larger
than the budget is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 16
#: Separators of words: space, tab, \n, \v, \f, \r.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Longer segments are hashed by blake2b, shorter ones eight bytes at a time.
LONG = 1024


class Chunk:
    """Rows lo..hi of a batch: data holds their UTF-8 bytes and PAD zero bytes, off their n + 1 offsets."""

    __slots__ = ("data", "hi", "lo", "n", "off", "size")

    def __init__(self, raw: bytes, off: np.ndarray, lo: int, hi: int):
        self.data = np.frombuffer(raw + b"\0" * PAD, dtype=np.uint8)
        self.off, self.lo, self.hi, self.n, self.size = off, lo, hi, hi - lo, len(raw)

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def chunks(column: pa.Array, budget: int = 4 << 20, table: bytes | None = None) -> Iterator[Chunk]:
    """Consecutive rows whose texts have about ``budget`` bytes. Null texts are empty. table: a byte translation."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = memoryview(data) if data is not None else memoryview(b"")
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        raw = bytes(whole[off[lo] : off[hi]])
        yield Chunk(raw.translate(table) if table else raw, off[lo : hi + 1] - off[lo], lo, hi)
        lo = hi


def words(c: Chunk, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte positions of all words; first[i] is the number of words before text i."""
    w = word[c.data[: c.size]]
    before, after = np.zeros_like(w), np.zeros_like(w)
    before[1:], after[:-1] = w[:-1], w[1:]
    inner = c.off[(c.off > 0) & (c.off < c.size)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, c.off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the segments' bytes. data must have 8 bytes after the last segment."""
    view = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _C1 + np.uint64(seed))
    todo = np.arange(len(starts))
    long = size > LONG
    at = 0
    while len(todo):
        rest = size[todo] - at
        h[todo] = mix((h[todo] ^ (view[starts[todo] + at] & _MASK[np.minimum(rest, 8)])) * _C1)
        at += 8
        todo = np.flatnonzero((size > at) & ~long) if at == 8 else todo[rest > 8]
    for i in np.flatnonzero(long):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + count], one after another."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(start - (end - count), count) + np.arange(total)]


class Interner:
    """Values of byte segments, worked out once per distinct segment while it is remembered.

    encode(list of bytes) returns (flat values, counts). At most ``limit`` segments are remembered:
    beyond that memory starts anew, which costs time and changes no result. Two segments count as
    equal if their 64-bit hashes, lengths, first and last eight bytes agree; a clash of hashes alone
    is told apart by hashing the batch anew under another seed.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 1_500_000):
        self.encode, self.dtype, self.limit, self.seed = encode, dtype, limit, 0
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.sign = np.empty((0, 3), np.uint64)
        self.start = self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, self.dtype)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of each segment's values in self.flat."""
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.keys) > self.limit:
            self.clear()
        view = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        while True:
            h = hashes(data, starts, ends, self.seed)
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            size = ends - starts
            head = view[starts] & _MASK[np.minimum(size, 8)]
            tail = view[np.maximum(ends - 8, starts)] & _MASK[np.minimum(size, 8)]
            sign = np.stack((size[first].astype(np.uint64), head[first], tail[first]), axis=1)
            back = first[inverse]
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            if (size == size[back]).all() and (head == head[back]).all() and (tail == tail[back]).all() and (self.sign[at[known]] == sign[known]).all():
                break
            self.seed += 1
            self.clear()
        start, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        start[known], count[known] = self.start[at[known]], self.count[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            flat, made = self.encode([data[a:b].tobytes() for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)])
            made = made.astype(np.int64)
            count[fresh] = made
            start[fresh] = len(self.flat) + np.cumsum(made) - made
            self.flat = np.concatenate((self.flat, flat.astype(self.dtype, copy=False)))
            everything = np.concatenate((self.keys, keys[fresh]))
            order = np.argsort(everything, kind="stable")
            self.keys = everything[order]
            self.sign = np.concatenate((self.sign, sign[fresh]))[order]
            self.start = np.concatenate((self.start, start[fresh]))[order]
            self.count = np.concatenate((self.count, count[fresh]))[order]
        return start[inverse], count[inverse]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i] : first[i + 1]] for each i."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
