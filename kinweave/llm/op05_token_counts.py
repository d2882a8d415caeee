"""Operator 5: token counts of a sentencepiece BPE model by rank-synchronous array merging.

Distinct pre-tokens (a blank mark and the characters after it) are held as one ragged numpy array of
symbols. In each round every sequence's lowest-ranked pair is found by a segmented minimum and applied
in all sequences at once; sequences with no pair left drop out, and surviving symbols are counted, a
symbol outside the vocabulary as its UTF-8 bytes. A sequence applies all places of its lowest pair
where no pair with the symbol made ranks as low, and its leftmost otherwise, as the library does.

What splits texts into pre-tokens is checked when the model is read: pieces hold the blank mark at
their start only, or are runs of it that rank behind everything else, and no longer piece holds a line
feed. Blank runs therefore merge last, by a rule that repeats with the longest run, read off the model once. The model must normalize
by identity and put one blank mark before a text.

Defined results: null and empty texts have 0 bytes and 0 tokens; nulls in doc_id and repeated rows stay
as they are; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, store

MARK = "▁"
BLANK = np.zeros(256, bool)
BLANK[0x20] = True
BODY = np.ones(256, bool)
BODY[[0x20, 0x0A]] = False
FAR = np.int64(1) << 60


#: Fixed value: the type of a user-defined piece in a model file.
USER_DEFINED = 4


def piece_types(path: str) -> set[int]:
    """Types of the pieces in a model file (1: normal, where none is told); pieces are its field 1, a piece's type is field 3."""

    def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte, at = raw[at], at + 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(raw):
            key = number()
            wire = key & 7
            if wire == 0:
                yield key >> 3, number()
                continue
            size = number() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, raw[at : at + size]
            at += size

    with open(path, "rb") as f:
        return {dict(fields(piece)).get(3, 1) for name, piece in fields(f.read()) if name == 1}



class Model:
    """Symbols, pair ranks and blank runs of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        if USER_DEFINED in piece_types(path):
            raise ValueError("user-defined pieces are matched before any merge, which is not done here")
        if own.normalize("a Ａ") != f"{MARK}a{MARK}Ａ":
            raise ValueError("the model must normalize by identity and put a blank mark first")
        rank = {own.id_to_piece(i): -own.get_score(i) for i in range(own.vocab_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))}
        runs = {p for p in rank if len(p) > 1 and not p.strip(MARK)}
        rest = [p for p in rank if p not in runs]
        if any(MARK in p[1:] for p in rest) or any("\n" in p for p in rank if len(p) > 1) or len({rank[p] for p in runs}) > 1 or runs and min(rank[p] for p in runs) < max((rank[p] for p in rest if len(p) > 1), default=0):
            raise ValueError("pieces of this model cross the borders of pre-tokens")
        #: Tokens of a run of so many blank marks; from the longest piece on, so many more marks are one token more.
        self.run = max(map(len, runs), default=1)
        self.blanks = np.array([0, *(len(own.encode(" " * k)) for k in range(1, 4 * self.run))], np.int64)
        self.blanks[1:] = [1, *self.blanks[1:-1]]
        if (self.blanks[self.run + 1 :] != self.blanks[1 : -self.run] + 1).any():
            raise ValueError("runs of blanks don't repeat with the longest piece")
        symbols = {p: i for i, p in enumerate(rest)}
        for p in rest:
            for ch in p:
                symbols.setdefault(ch, len(symbols))
        known = np.zeros(len(symbols), bool)
        known[: len(rest)] = True
        self.mark = symbols[MARK]
        order = {r: k for k, r in enumerate(sorted({rank[p] for p in rest}))}
        pairs = {}
        for p in rest:
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] << 32 | symbols[p[k:]]] = (order[rank[p]], symbols[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        lowest = np.full(len(symbols), FAR)
        np.minimum.at(lowest, self.keys >> 32, self.ranks)
        np.minimum.at(lowest, self.keys & 0xFFFFFFFF, self.ranks)
        owner = np.full(len(order), -1, np.int64)  # the one symbol of a rank
        many = np.zeros(len(order), bool)
        for p in rest:
            k = order[rank[p]]
            if len(p) > 1:
                many[k] |= owner[k] >= 0
                owner[k] = symbols[p]
        self.safe = (owner >= 0) & ~many & (lowest[owner] > np.arange(len(order)))
        size = np.array([1 if known[i] else len(p.encode()) for p, i in symbols.items()], np.int64)
        self.cost = np.append(size, 0)
        self.chars = np.array([ord(p) for p in symbols if len(p) == 1], np.int64)
        at = np.argsort(self.chars)
        self.chars = self.chars[at]
        self.char_symbols = np.array([i for p, i in symbols.items() if len(p) == 1], np.int64)[at]

    def blank_tokens(self, length: np.ndarray) -> np.ndarray:
        over = np.maximum(length - 1, 0) // self.run
        return over + self.blanks[length - over * self.run]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made); FAR for no pair."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = (self.keys[at] == want) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], FAR), self.made[at]


def count_pretokens(model: Model, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs: tokens of each part, 1 if its first symbol is still the lone blank mark; twos)."""
    raw = np.frombuffer(b"".join(parts).decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(p.decode("utf-8")) for p in parts], np.int64)
    raw[raw == 0x20] = ord(MARK)
    at = np.minimum(np.searchsorted(model.chars, raw), len(model.chars) - 1)
    known = model.chars[at] == raw
    symbol = np.where(known, model.char_symbols[at], -1)
    # a character of no piece never merges and counts as its bytes
    width = np.where(known, 0, 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF))
    tokens = np.bincount(np.repeat(np.arange(len(parts)), sizes), width, len(parts)).astype(np.int64)
    lone = np.zeros(len(parts), np.int64)
    seq = np.repeat(np.arange(len(parts)), sizes)
    rank, made = np.full(len(symbol), FAR), np.zeros(len(symbol), np.int64)
    if len(symbol) > 1:
        rank[:-1], made[:-1] = model.pair(symbol[:-1], symbol[1:])
        rank[:-1][seq[1:] != seq[:-1]] = FAR
    while len(symbol):
        first = np.flatnonzero(np.diff(seq, prepend=-1))
        low = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(seq)))
        over = low == FAR
        if over.any():
            done = np.repeat(over, length)
            tokens += np.bincount(seq[done], model.cost[symbol[done]], len(parts)).astype(np.int64)
            lone[seq[first[over]]] = symbol[first[over]] == model.mark
            symbol, seq, rank, made = symbol[~done], seq[~done], rank[~done], made[~done]
            low, length = low[~over], length[~over]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == np.repeat(low, length))
        place = np.arange(len(at))
        new = np.concatenate((np.ones(1, bool), seq[at[1:]] != seq[at[:-1]]))
        chained = np.concatenate((np.zeros(1, bool), at[1:] == at[:-1] + 1)) & ~new
        head = np.maximum.accumulate(np.where(chained, 0, place))
        at = at[np.where(model.safe[rank[at]], (place - head) % 2 == 0, new)]
        symbol[at] = made[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbol, seq, rank, made = symbol[keep], seq[keep], rank[keep], made[keep]
        at = moved[at]
        todo = np.unique(np.concatenate((at, at[at > 0] - 1)))
        todo = todo[todo + 1 < len(symbol)]
        rank[at] = FAR
        rank[todo], made[todo] = model.pair(symbol[todo], symbol[todo + 1])
        rank[todo[seq[todo] != seq[todo + 1]]] = FAR
    return np.stack((tokens, lone), axis=1).ravel(), np.full(len(parts), 2)


@cache
def loaded(path: str) -> tuple[Model, ragged.Interner]:
    model = Model(path)
    return model, ragged.Interner(lambda parts: count_pretokens(model, parts), np.int32)


def count_column(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text."""
    model, interner = loaded(path)
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
    empty = pc.equal(pc.binary_length(column), 0)
    column = pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    out = []
    for c in ragged.chunks(column):
        starts, ends, first = ragged.words(c, BODY)
        edge = np.zeros(c.size + 1, bool)
        edge[c.off] = True
        led = ~edge[starts] & (c.data[starts - 1] == 0x20) if len(starts) else np.empty(0, bool)
        at, _ = interner.lookup(c.data, starts - led, ends)
        counts, lone = interner.flat[at].astype(np.int64), interner.flat[at + 1] * led
        runs, run_ends, run_first = ragged.words(c, BLANK)
        blanks = run_ends - runs
        led_to = ~edge[run_ends] & (c.data[run_ends] != 0x0A)  # runs with a pre-token behind them, in the same order
        blanks[led_to] -= 1 - lone[led]
        counts = counts - lone
        lines = np.concatenate((np.zeros(1, np.int64), np.cumsum(c.data[: c.size] == 0x0A)))[c.off]
        out.append(ragged.sums(counts, first) + ragged.sums(model.blank_tokens(blanks), run_first) + np.diff(lines))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_column(batch.column(1), model)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(store.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
