"""Operator 2: quality rules by repetition coverage.

Word hashes of a chunk roll into hashes of n-grams of several lengths, each length by one multiply and
add from the last; equal n-grams of a text are found by sorting, and what they cover, first places
included, is counted in characters. Lines are compared by hashes of their bytes. A text is rejected if
the base rule rejects it, if n-grams that it repeats cover more of its word characters than the limit
of their length, or if lines that repeat an earlier one hold more than a limit.

Defined results: null and empty texts have no words and are rejected as too short; nulls in doc_id and
repeated rows stay as they are; empty tables give no row; extra columns stay out of verdicts, and
filter_documents() returns them untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, store

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words in a window of the base rule.
WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may lie in repeated windows.
BASE_PERCENT = 30
#: Length of n-grams: percent of word characters that repeated ones may cover.
COVERAGE = {5: 40, 8: 35, 10: 30}
#: Percent of word characters that may lie in lines equal to an earlier line.
LINE_PERCENT = 30
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"cover_{n} double" for n in COVERAGE) + ", line_percent double"

_BASE = np.uint64(0x9E3779B97F4A7C55)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(key)
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def measure(c: ragged.Chunk) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for the texts of a chunk."""
    starts, ends, first = ragged.words(c)
    n_words = np.diff(first)
    raw = c.data[: c.size]
    # code points in words before each byte
    points = np.concatenate((np.zeros(1, np.int64), np.cumsum(ragged.WORD[raw] & ((raw & 0xC0) != 0x80))))
    word_chars = np.diff(points[c.off])
    symbols = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(_SYMBOL[raw])))[c.off])
    h = ragged.hashes(c.data, starts, ends)
    text = np.repeat(np.arange(c.n), n_words)
    left = np.repeat(first[1:], n_words) - np.arange(len(starts))  # words from here to the text's end
    salt = ragged.mix(text.astype(np.uint64) + np.uint64(1))
    chars = points[ends] - points[starts]
    cover, rolling = [], h
    repeat_words = np.zeros(c.n, np.int64)
    for n in range(2, max(COVERAGE) + 1):
        rolling = rolling[: max(len(h) - n + 1, 0)] * _BASE + h[n - 1 :]
        if n not in COVERAGE:
            continue
        at = np.flatnonzero(left[: len(rolling)] >= n)
        at = at[_repeated(ragged.mix(rolling[at]) ^ salt[at])]
        step = np.bincount(at, minlength=len(h) + 1)
        step[: len(h) + 1] -= np.bincount(at + n, minlength=len(h) + 1)[: len(h) + 1]
        inside = np.cumsum(step[: len(h)]) > 0
        cover.append(ragged.sums(chars * inside, first))
        if n == WINDOW:
            repeat_words = ragged.sums(inside, first)
    # lines
    feed = np.flatnonzero(raw == 0x0A)
    owner = np.concatenate((np.searchsorted(c.off, feed, "right") - 1, np.arange(c.n)))
    line_ends = np.concatenate((feed, c.off[1:]))
    order = np.lexsort((line_ends, owner))
    owner, line_ends = owner[order], line_ends[order]
    line_starts = np.concatenate((np.zeros(1, np.int64), line_ends[:-1] + 1)) if len(line_ends) else line_ends
    fresh = np.diff(owner, prepend=-1) > 0
    line_starts[fresh] = c.off[owner[fresh]]
    line_chars = points[line_ends] - points[line_starts]
    has = line_chars > 0
    line_starts, line_ends, owner, line_chars = line_starts[has], line_ends[has], owner[has], line_chars[has]
    key = ragged.hashes(c.data, line_starts, line_ends) ^ ragged.mix(owner.astype(np.uint64) + np.uint64(1))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    dup_lines = np.bincount(owner[again], minlength=c.n)
    dup_chars = np.bincount(owner[again], line_chars[again], c.n)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat_words > BASE_PERCENT * n_words)
    whole = np.maximum(word_chars, 1)
    percent = np.stack([100.0 * x / whole for x in cover], axis=1)
    line_percent = 100.0 * dup_chars / whole
    kept = ~base_failed & (percent <= np.array(list(COVERAGE.values()))).all(axis=1) & (line_percent <= LINE_PERCENT)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": kept, **{f"cover_{n}": percent[:, i] for i, n in enumerate(COVERAGE)}, "line_percent": line_percent}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of SCHEMA of each row."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ragged.chunks(batch.column(1)):
                m = measure(c)
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi], *(pa.array(v) for v in m.values())], names=["doc_id", *m])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(report, "doc_id long, " + SCHEMA)


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns as they are."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [measure(c)["kept"] for c in ragged.chunks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(store.documents(spark, sf_dir))


def _cover_sql(n: int) -> str:
    """Word characters of each text that n-grams found twice or more cover: a word is inside if such a gram starts up to n - 1 words before."""
    return f"""
c{n} AS (
  SELECT doc_id, coalesce(sum(chars) FILTER (inside), 0) AS chars, count(*) FILTER (inside) AS words FROM (
    SELECT doc_id, chars, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS inside FROM (
      SELECT doc_id, i, chars, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS twice FROM (
        SELECT doc_id, i, length(w[i]) AS chars, CASE WHEN i + {n - 1} <= len(w) THEN array_to_string(w[i : i + {n - 1}], ' ') END AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)))) GROUP BY doc_id)"""


#: DuckDB SQL for the rows of query(), where doc_id is unique.
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
{",".join(_cover_sql(n) for n in COVERAGE)},
lines AS (
  SELECT doc_id, line, count(*) AS n, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(n - 1) AS n, sum((n - 1) * chars) AS chars FROM lines GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(c8.words, 0) AS n_repeat_words,
    {", ".join(f"100.0::DOUBLE * coalesce(c{n}.chars, 0) / greatest(length(array_to_string(w, '')), 1) AS cover_{n}" for n in COVERAGE)}, 100.0::DOUBLE * coalesce(dup.chars, 0) / greatest(length(array_to_string(w, '')), 1) AS line_percent
  FROM t LEFT JOIN dup USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in COVERAGE)})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words) AND {" AND ".join(f"cover_{n} <= {p}" for n, p in COVERAGE.items())} AND line_percent <= {LINE_PERCENT} AS kept,
  {", ".join(f"cover_{n}" for n in COVERAGE)}, line_percent
FROM m
"""
