"""Operator 1: token files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id, encoded with the tokenizers library and written
as shards: one array of ids of the narrowest width that holds the vocabulary, and two Elias-Fano lists,
the doc_ids and the document boundaries in that array. An Elias-Fano list of n values up to u takes about n * (2 + log2(u / n)) bits; sampled select answers "where does document i start" from it. The reader
walks over a shard by windows of the select structure, EVERY documents at a time, and expands no list; the writer
holds the lengths of its own shard's documents only. A shard is closed once it holds ``shard_tokens`` ids, with less
than as many again or one document beyond, so that memory is bounded on either side.

Defined results: a null text is an empty document (its end id alone); empty tables give no shard and no
row; repeated rows and equal doc_ids are documents of their own, in an order of their texts' digests; rows without a
doc_id come last, in the same order; extra columns are ignored, and a column named like a result is of no effect.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pretokens, ragged, store

MAGIC = b"KWTOKEF1"
#: A select sample for so many values.
EVERY = 256
#: ids in a shard.
SHARD_TOKENS = 8 << 20


class EliasFano:
    """A non-decreasing list of non-negative integers: low bits packed, high bits in unary, select by samples."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(n, low_bits, low, high, at[::EVERY].astype(np.uint32))

    def block(self, k: int) -> np.ndarray:
        """Values k * EVERY and after, EVERY of them at most: from one sample to the next."""
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (last + 7) >> 3], bitorder="little")
        at = np.flatnonzero(bits) + (first & ~7)
        at = at[(at >= first) & (at < last)]
        i = np.arange(k * EVERY, k * EVERY + len(at))
        high = (at - i).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        place = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1)
        return high | (bit.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // EVERY)[i % EVERY])

    def blocks(self, extra: int = 0) -> Iterator[np.ndarray]:
        """The windows of EVERY values in order; extra = 1 adds the value after each, the next window's first."""
        now = self.block(0) if self.n else np.empty(0, np.uint64)
        for k in range(len(self.samples)):
            after = self.block(k + 1) if k + 1 < len(self.samples) else now[:0]
            yield np.concatenate((now, after[:extra]))
            now = after

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """The list at the start of raw, and its size in bytes."""
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        end = at + a + b + 4 * c
        return cls(n, low_bits, np.frombuffer(raw[at : at + a], np.uint8), np.frombuffer(raw[at + a : at + a + b], np.uint8), np.frombuffer(raw[at + a + b : end], "<u4")), end


class Shard:
    """One file: magic, id width, EF list of doc_ids less the smallest, EF list of boundaries, ids. Documents without a doc_id come last."""

    def __init__(self, base: int, doc_ids: EliasFano, bounds: EliasFano, ids: np.ndarray):
        self.base, self.doc_ids, self.bounds, self.ids = base, doc_ids, bounds, ids

    @staticmethod
    def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: list[np.ndarray]) -> bytes:
        """doc_ids: those of the first documents; counts: of all, which may be more."""
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        base = int(doc_ids[0]) if len(doc_ids) else 0
        head = MAGIC + struct.pack("<Bq", ids[0].itemsize, base) + EliasFano.of(doc_ids - base).to_bytes() + EliasFano.of(bounds).to_bytes()
        return b"".join([head, *(x.tobytes() for x in ids)])

    @classmethod
    def read(cls, raw: bytes) -> Shard:
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(raw)
        width, base = struct.unpack_from("<Bq", view, 8)
        at = 8 + struct.calcsize("<Bq")
        doc_ids, n = EliasFano.read(view[at:])
        bounds, m = EliasFano.read(view[at + n :])
        return cls(base, doc_ids, bounds, np.frombuffer(view[at + n + m :], f"<u{width}"))

    def document(self, i: int) -> np.ndarray:
        """ids of document i, found by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(doc_ids, boundaries: one more than documents) of EVERY documents at a time; the doc_ids of documents without one are missing."""
        named = self.doc_ids.blocks()
        for bounds in self.bounds.blocks(1):
            if len(bounds) > 1:
                yield next(named, np.empty(0, np.uint64)).astype(np.int64) + self.base, bounds.astype(np.int64)


@cache
def library(path: str):
    """The tokenizer, the strings that it takes as special, and an interner of its pre-tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    dtype = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], []
        for lo in range(0, len(parts), 5000):
            some = [p.decode("utf-8") for p in parts[lo : lo + 5000]]
            got = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(got.ids, dtype))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(flat), np.concatenate(counts)

    return tokenizer, special, ragged.Interner(encode, dtype)


def encode_chunk(c: ragged.Chunk, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text), as the tokenizers library encodes each whole text."""
    tokenizer, special, interner = library(path)
    starts, ends, first = pretokens.split(c)
    at, count = interner.lookup(c.data, starts, ends)
    tail = 0 if end_id is None else 1
    sizes = ragged.sums(count, first)
    raw = c.data.tobytes() if any(s in c.data.tobytes() for s in special) else b""
    odd = [i for i in range(c.n) if raw and any(s in c.text(i) for s in special)]  # these go whole through the library
    whole = {i: np.array(tokenizer.encode(c.text(i).decode(), add_special_tokens=False).ids, interner.dtype) for i in odd}
    ids = ragged.gather(interner.flat, at, count)
    if not tail and not whole:
        return ids, sizes
    for i, own in whole.items():
        sizes[i] = len(own)
    out = np.empty(int(sizes.sum()) + tail * c.n, interner.dtype)
    ends_at = np.cumsum(sizes + tail)
    keep = np.ones(len(out), bool)
    if tail:
        out[ends_at - 1] = end_id
        keep[ends_at - 1] = False
    if whole:
        mine = np.repeat(np.isin(np.arange(c.n), odd), ragged.sums(count, first))
        ids = ids[~mine]
        for i, own in whole.items():
            lo = ends_at[i] - tail - len(own)
            out[lo : lo + len(own)] = own
            keep[lo : lo + len(own)] = False
    out[keep] = ids
    return out, sizes + tail


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards of docs to uri, a folder that all executors reach, and returns their manifest.

    Manifest: shard string (names sort as the documents do), n_docs, n_tokens, n_bytes. A task that runs again writes the
    same shards under the same names. Equal doc_ids, or none, are spread over partitions by their texts' digests.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        doc_ids, counts, ids, held, made = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, counts, ids, held, made
            n = np.concatenate(counts)
            raw = Shard.pack(np.concatenate(doc_ids), n, ids)
            name = f"shard-{task.partitionId():07d}-{made:05d}.tok"
            store.put_bytes(uri, name, raw, f"{task.taskAttemptId()}")
            out = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(n)], "n_tokens": [held], "n_bytes": [len(raw)]})
            doc_ids, counts, ids, held, made = [], [], [], 0, made + 1
            return out

        for batch in batches:
            for c in ragged.chunks(batch.column(1), min(4 << 20, shard_tokens)):
                flat, n = encode_chunk(c, tokenizer, end_id)
                doc_ids.append(batch.column(0)[c.lo : c.hi].drop_null().to_numpy())
                counts.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= shard_tokens:
                    yield flush()
        if counts:
            yield flush()

    last = F.col("doc_id").asc_nulls_last()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    ordered = rows.repartitionByRange(last, "digest").sortWithinPartitions(last, "digest", "text").select("doc_id", "text")
    manifest = ordered.mapInArrow(write, "shard string, n_docs long, n_tokens long, n_bytes long")
    return store.keep(manifest, "token-manifest")


def read_token_files(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """One row a document, from the shards' bytes: doc_id, start over all shards, n_tokens, ids_crc32, shard, in_shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard.read(content.as_py())
                name = path.as_py().rsplit("/", 1)[-1]
                for doc_ids, bounds in shard.windows():
                    n = len(bounds) - 1
                    block = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    at = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(block[a:b]) for a, b in zip(at, at[1:], strict=False)]
                    named = pa.concat_arrays([pa.array(doc_ids, pa.int64()), pa.nulls(n - len(doc_ids), pa.int64())])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), named, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tok").schema("path string, modificationTime timestamp, length long, content binary")
    if manifest.isEmpty():
        rows = spark.createDataFrame([], "shard string, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    else:
        rows = files.load(uri).select("path", "content").mapInArrow(read, "shard string, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard, of eight million ids: Spark picks the join by the manifest's measured size
    bases = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "in_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = store.new_dir(spark, "token-files")
    manifest = write_token_files(store.documents(spark, sf_dir), uri, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, uri, manifest)
