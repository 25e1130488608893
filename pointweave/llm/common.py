"""What the corpus operators share: Arrow access to text, word hashing, folds
and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.plans.ship import ship
from pointweave.plans.storage import stored

#: Bytes of text that a worker holds as numpy arrays at once; one longer
#: document is a chunk of its own.
CHUNK_BYTES = 1 << 20

__all__ = ["CHUNK_BYTES", "Words", "arrow_map", "documents", "fold", "grams", "hash_spans", "mix", "pieces", "stored", "text_buffers"]


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over chunks of bounded text size (the largest string column decides)."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK_BYTES of text each, or one row."""
    if batch.num_rows == 0:
        return
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    if not texts:
        yield batch
        return
    offsets = max((text_buffers(c)[1] for c in texts), key=lambda o: o[-1])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and its n+1 offsets (from 0).
    Nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    n = len(arr)
    _, offs, data = arr.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


# --- hashing ---------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, A-Z lower-cased.

    start, end: byte places in ``raw`` (lower-cased bytes of all texts);
    doc: the row of each word; first: for each row its first word (n+1 entries).
    """

    def __init__(self, arr: pa.Array):
        raw, offsets = text_buffers(arr)
        self.raw, self.offsets = _LOWER[raw], offsets
        inside = ~_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = inside[heads]
        self.start = np.flatnonzero(begins)
        # a word ends at the next blank, at the next word, or with its text
        stops = np.flatnonzero(~inside)
        nxt = np.searchsorted(stops, self.start)
        end = np.append(stops, len(raw))[nxt]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.end = np.minimum(end, offsets[self.doc + 1])
        self.first = np.searchsorted(self.doc, np.arange(len(arr) + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.raw, self.start, self.end)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty run of bytes, CHUNK_BYTES of them at a time (one
    longer run is worked alone)."""
    out = np.zeros(len(start), np.uint64)
    length = end - start
    upto = np.cumsum(length)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK_BYTES, side="right")))
        own = length[i:j]
        ends = np.cumsum(own)
        place = np.arange(ends[-1]) - np.repeat(ends - own, own)
        terms = _BYTE[raw[place + np.repeat(start[i:j], own)]] * _odd_powers(_BASE, int(own.max()))[place]
        out[i:j] = mix(np.add.reduceat(terms, ends - own) + own.astype(np.uint64))
        i = j
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries of ``h``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    mult = _odd_powers(0x9FB21C651E98DF25, n + 1)[1:]
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += h[i : i + m] * mult[i]
    return mix(total)
