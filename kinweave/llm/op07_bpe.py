"""Operator 7: byte-level BPE by a hierarchical-bitmap rank queue, and its decoding.

All distinct pre-tokens of a chunk that are not remembered form one linked list of byte symbols with
barriers between them. A bucket for each merge rank holds the list positions whose pair has that rank;
a bitmap of three levels of 64-bit words tells which buckets hold anything, so that the next rank is
three find-first-set steps away, whatever the number of symbols. A bucket is taken whole: entries
whose pair has changed meanwhile are stale and skipped, of overlapping ones the left goes first, the
merges are made, and the new pairs go to their buckets. Merges in different pre-tokens don't touch, so
this is the order of each pre-token's own merges; a very long pre-token takes O(n log n) as a short one.
That taking a bucket whole is right within one pre-token needs that none of its merges makes a pair of
a rank up to its own, which the vocabulary tells for each rank; where it can, each pre-token merges its
first pair and the rest of the bucket waits for the next turn.

Defined results: null and empty texts have no ids, and decode to no bytes; nulls in doc_id and repeated
rows are kept as they are; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens, ragged, store


class RankQueue:
    """Buckets of list positions by rank under a bitmap of three levels; ranks below 64 ** 3."""

    def __init__(self, ranks: int):
        if ranks > 64**3:
            raise ValueError("at most 262,144 ranks")
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Any number of entries, of any ranks, positions in order."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, a, b in zip(ranks[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(ranks)], strict=True):
            self.buckets.setdefault(r, []).append(positions[a:b])
            self.leaf[r >> 6] |= 1 << (r & 63)
            self.mid[r >> 12] |= 1 << (r >> 6 & 63)
            self.top |= 1 << (r >> 12)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its bucket, positions in order."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        j = i << 6 | (self.mid[i] & -self.mid[i]).bit_length() - 1
        r = j << 6 | (self.leaf[j] & -self.leaf[j]).bit_length() - 1
        self.leaf[j] &= self.leaf[j] - 1
        if not self.leaf[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        found = self.buckets.pop(r)
        return r, found[0] if len(found) == 1 else np.sort(np.concatenate(found))


class Vocabulary:
    """Ranks of byte strings, as tiktoken takes them: any two symbols whose joint bytes have a rank may merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        made = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        lowest = np.full(self.size, self.size)
        np.minimum.at(lowest, self.keys >> 32, self.made)
        np.minimum.at(lowest, self.keys & 0xFFFFFFFF, self.made)
        #: No pair with the symbol that this rank makes has a rank up to this one.
        self.safe = lowest > np.arange(self.size)
        by_id = [b""] * self.size
        for t, r in ranks.items():
            by_id[r] = t
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.count = np.array([len(t) for t in by_id], np.int64)
        self.start = np.cumsum(self.count) - self.count

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, which is its rank; -1 for none."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.made[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged.gather(self.flat, self.start[ids], self.count[ids]).tobytes()


def encode_pretokens(vocabulary: Vocabulary, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each part)."""
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(parts), np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)
    symbol = vocabulary.byte[raw]
    following = np.arange(1, n + 1)
    previous = np.arange(-1, n - 1)
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    lasts = (np.cumsum(sizes) - 1)[sizes > 0]
    previous[firsts] = -1
    following[lasts] = -1
    rank = np.full(n, -1, np.int64)  # of the pair that starts here; -1 too where no symbol starts any more
    inner = np.flatnonzero(following >= 0)
    rank[inner] = vocabulary.rank(symbol[inner], symbol[inner + 1])
    live = np.flatnonzero(rank >= 0)
    queue = RankQueue(vocabulary.size)
    queue.push(rank[live], live)
    alive = np.ones(n, bool)
    while (taken := queue.pop()) is not None:
        r, at = taken
        at = at[rank[at] == r]  # the others are stale
        if not len(at):
            continue
        if len(at) > 1:
            repeated = np.concatenate((np.zeros(1, bool), at[1:] == at[:-1]))
            at = at[~repeated]
            if vocabulary.safe[r]:
                # of a chain of overlapping pairs, every other one from the left
                chained = np.concatenate((np.zeros(1, bool), following[at[:-1]] == at[1:]))
                if chained.any():
                    place = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[(place - head) % 2 == 0]
            else:
                ones = np.concatenate((np.ones(1, bool), part[at[1:]] != part[at[:-1]]))
                if not ones.all():
                    queue.push(np.full(int((~ones).sum()), r), at[~ones])
                    at = at[ones]
        gone = following[at]
        after = following[gone]
        symbol[at] = r
        alive[gone] = False
        rank[gone] = -1
        rank[at] = -1
        following[at] = after
        has = after >= 0
        previous[after[has]] = at[has]
        before = previous[at]
        left = np.unique(np.concatenate((before[before >= 0], at[has])))
        if len(left):
            new = vocabulary.rank(symbol[left], symbol[following[left]])
            rank[left] = new
            good = new >= 0
            if good.any():
                queue.push(new[good], left[good])
    kept = np.flatnonzero(alive)
    return symbol[kept], np.bincount(part[kept], minlength=len(parts))


@cache
def loaded(path: str) -> tuple[Vocabulary, ragged.Interner]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    vocabulary = Vocabulary(ranks)
    return vocabulary, ragged.Interner(lambda parts: encode_pretokens(vocabulary, parts), np.uint16 if vocabulary.size <= 1 << 16 else np.uint32)


def encode_texts(path: str, column: pa.Array) -> Iterator[tuple[ragged.Chunk, np.ndarray, np.ndarray]]:
    """For each chunk of texts: the chunk, its ids, and the offsets of each text's ids."""
    _, interner = loaded(path)
    for c in ragged.chunks(column):
        starts, ends, first = pretokens.split(c)
        at, count = interner.lookup(c.data, starts, ends)
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(ragged.sums(count, first))))
        yield c, ragged.gather(interner.flat, at, count), bounds


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, ids, bounds in encode_texts(ranks, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi], lists], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids again and returns doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(ranks)
        for batch in batches:
            for c, ids, bounds in encode_texts(ranks, batch.column(1)):
                raw = memoryview(ids.astype("<u4").tobytes())
                sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(vocabulary.count[ids])))[bounds].tolist()
                decoded = memoryview(vocabulary.decode(ids))
                at = bounds.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[c.lo : c.hi],
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]),
                        pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(sizes, sizes[1:], strict=False)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and text of rows that encode_documents() made; bytes that are no UTF-8 become U+FFFD."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(ranks)
        for batch in batches:
            texts = [vocabulary.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(store.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
