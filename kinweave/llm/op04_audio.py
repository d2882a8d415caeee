"""Operator 4: audio columns: WAV by the wave module, short-time Fourier transforms, peak-pair fingerprints.

A text's bytes, padded to a multiple of 64, are the samples of an 8-bit mono WAV file, held in a binary
column of a table in the shared folder. From the column read back, frames are transformed, spectral
peaks picked, and each peak paired with the next few: (frequency, frequency, distance in frames) is a
fingerprint and the frame its time code; both are stored as arrays in time order, in a second table of the
shared folder, from which the digests of the query are read.

Defined results: a null or empty text is 64 zero bytes; equal texts have equal media and features; the
last frame is padded with silence; nulls in doc_id and repeated rows
stay as they are; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged, store

RATE = 8000
UNIT = 64
FRAME = 256
HOP = 128
#: Peaks of a frame, partners of a peak, largest distance of partners in frames.
PEAKS = 2
PARTNERS = 3
REACH = 8
#: Frames transformed at a time, and documents whose arrays are held at a time.
BLOCK = 4096
ROWS = 64
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(samples: bytes) -> bytes:
    """An 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getnchannels() != 1 or r.getsampwidth() != 1:
            raise ValueError("8-bit mono is expected")
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of the spectral peaks, in time order, by falling strength within a frame."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x = np.concatenate((x, np.zeros(max(FRAME - len(x), (FRAME - len(x)) % HOP), np.float32)))  # whole frames to the last sample
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for lo in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[lo : lo + BLOCK] * _WINDOW, axis=1)[:, 1:])  # without the mean
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.argpartition(-top, PEAKS - 1, axis=1)[:, :PEAKS]
        strength = np.take_along_axis(top, best, 1)
        order = np.lexsort((best, -strength), axis=1) if len(best) else best
        best, strength = np.take_along_axis(best, order, 1), np.take_along_axis(strength, order, 1)
        t = np.repeat(np.arange(lo, lo + len(best)), PEAKS)
        found = strength.ravel() > 0
        times.append(t[found])
        bins.append(best.ravel()[found] + 2)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time codes, hashes) of the peak pairs: frequency << 16 | partner's frequency << 8 | distance."""
    t, f = peaks(samples)
    codes, prints = [], []
    for k in range(1, PARTNERS + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        codes.append(t[:-k][near])
        prints.append((f[:-k] << 16 | f[k:] << 8 | gap)[near])
    codes, prints = np.concatenate(codes), np.concatenate(prints)
    order = np.lexsort((prints, codes))
    return codes[order].astype(np.int32), prints[order].astype(np.int32)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (WAV) of each row, as a table in the shared folder."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ragged.chunks(batch.column(1)):
                size = np.diff(c.off)
                media = [to_wav((raw := c.text(i)) + b"\0" * (-len(raw) % UNIT if raw else UNIT)) for i in range(c.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi], pa.array(size), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store.keep(rows.mapInArrow(make, "doc_id long, n_bytes long, media binary"), "media")


def fingerprint_media(media: DataFrame) -> DataFrame:
    """What is read back of each row's media, with the fingerprints as time-coded arrays, as a table in the shared folder.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, times array<int>, prints array<int>.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                rows, codes, prints = [], [], []
                for i in range(some.num_rows):
                    stored = some.column(2)[i].as_py()
                    payload = from_wav(stored)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest()))
                    times, found = fingerprints(payload)
                    codes.append(times)
                    prints.append(found)
                columns = [pa.array(v) for v in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns, _lists(codes), _lists(prints)], names=[*names, "times", "prints"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, prints array<int>"
    return store.keep(media.select("doc_id", "n_bytes", "media").mapInArrow(make, schema), "fingerprints")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def digest_fingerprints(found: DataFrame) -> DataFrame:
    """What op4's contract names: the media's digests, and feature, a digest of the stored arrays."""
    said = F.concat_ws(";", F.array_join("times", ","), F.array_join("prints", ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", F.size("prints"), F.sha2(said, 256)).alias("feature"), F.size("prints").cast("long").alias("n_prints"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_fingerprints(fingerprint_media(store_media(store.documents(spark, sf_dir))))
