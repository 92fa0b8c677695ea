"""Helpers shared by the operators: folds, batches of bounded size, hashing of words in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with all columns but ``keep`` under names of their place, so that none clashes with an operator's own."""
    return df.toDF(*[c if c in keep else f"_column{i}" for i, c in enumerate(df.columns)])


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, each followed by a space, and the offsets of the rows. Null is empty."""
    parts = [(v or "").encode() for v in column.to_pylist()]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8) if parts else np.zeros(0, np.uint8), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    """Odd 64-bit factors for multilinear hashing."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) * GOLDEN) | np.uint64(1)


FACTORS = multipliers(4096)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def factors(n: int) -> np.ndarray:
    return FACTORS if n <= len(FACTORS) else multipliers(n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and per row the index of its first word.

    ``data`` has a blank after each row, so no word crosses rows. A word's hash is
    the sum of byte times a factor per place, finalized, so it takes a fixed number
    of array passes whatever the words are.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~BLANK[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = ends - starts
    letters = LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(letters * factors(int(lengths.max()))[place], first)
        return mix(sums + lengths.astype(np.uint64) * GOLDEN), np.searchsorted(starts, offsets)
