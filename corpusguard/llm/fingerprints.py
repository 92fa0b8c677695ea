"""Document fingerprints by quartile buckets, and their comparison.

The byte triplets within five-byte windows are hashed into ``BUCKETS`` counters. The
fingerprint holds, for each counter, the quartile of all counters that it falls
into, the logarithm of the length and the ratios of the quartiles. Two fingerprints
differ by the sum of the steps between their codes; the difference is cut at a bound
and turned into a likeness from 0 to 1.

Nulls and edges: a null text is empty; texts under five bytes have no triplets and are
told apart by their length alone. Equal texts have equal fingerprints. Neighbours:
the next document has the next lower id, of rows with the same id the one with the
next text, and the last row is followed by the first. A row without id has no place in
that order and is its own next document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import tasks

BUCKETS = 256
#: Offsets of the second and third byte of each triplet, and its odd factors.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
#: Difference of two codes: one step, two steps, and opposite ends, which count more than their steps.
STEPS = np.asarray([0, 1, 2, 6])
LENGTH_STEP, RATIO_STEP = 2, 3
#: The expected difference of unrelated codes; at this or more the likeness is 0.
BOUND = BUCKETS * 26 / 16


def fingerprint(body: bytes) -> np.ndarray:
    """Length code, two ratio codes and a code from 0 to 3 per bucket."""
    data = np.frombuffer(body, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data) - 4
    if n > 0:
        with np.errstate(over="ignore"):
            first, second, third = (data * f for f in FACTORS)
            for kind, (i, j) in enumerate(TRIPLETS):
                key = (first[:n] + second[i:i + n] + third[j:j + n]) ^ np.uint32(kind * 0x9E3779B9 & 0xFFFFFFFF)
                key *= np.uint32(2654435769)
                counts += np.bincount(key >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = np.empty(3 + BUCKETS, np.uint8)
    code[0] = min(255, int(np.log1p(len(body)) / np.log(1.1)))
    code[1:3] = (q1 * 15 // max(1, q3), q2 * 15 // max(1, q3))
    code[3:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return code


def encoded(code: np.ndarray) -> str:
    """The length as two, the ratios as one, and two buckets as one hexadecimal digit each."""
    pairs = code[3::2] * 4 + code[4::2]
    return f"{code[0]:02x}{code[1]:x}{code[2]:x}" + (pairs[0::2] * 16 + pairs[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, 0 for those that differ as unrelated ones do."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    steps = np.abs(a - b)
    difference = STEPS[steps[3:]].sum() + LENGTH_STEP * steps[0] + RATIO_STEP * steps[1:3].sum()
    return float(max(0.0, 1.0 - difference / BOUND))


def with_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows with an id, dealt by ranges of ids: block, extra. The first row of each block also goes, as extra, to the
    block before it in descending order, and that of the highest block to the lowest."""
    bounds = docs.stat.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    edges = [-float("inf"), *sorted(set(bounds) or {0.0}), float("inf")]
    dealt = Bucketizer(splits=edges, inputCol="_id", outputCol="_block").transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    dealt = dealt.select("doc_id", "text", F.col("_block").cast("int").alias("block"))
    heads = sorted((r["block"], r["head"]) for r in dealt.groupBy("block").agg(F.max("doc_id").alias("head")).collect())
    follows = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    followed = docs.sparkSession.createDataFrame(follows, "doc_id long, other int")  # one row per block
    both = dealt.join(F.broadcast(followed), "doc_id", "left")
    places = F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("e")), F.struct(F.col("other").alias("b"), F.lit(1).alias("e")))
    return (both.select("doc_id", "text", F.explode(places).alias("p")).where("p.b IS NOT NULL")
            .select("doc_id", "text", F.col("p.b").alias("block"), F.col("p.e").alias("extra")))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(doc_id, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = (text[:len(text) - half] + following[:half]).encode()
    changed = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), encoded(own), encoded(changed), likeness(own, changed), likeness(own, its))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], [c.split()[0] for c in SCHEMA.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, that of the text whose last half is replaced by the
    start of the next document, and the likeness of its fingerprint to that and to the next document's.

    Texts are shuffled once, by ranges of ids; a task holds two documents at a time.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for doc_id, text, block, extra in zip(*(batch.column(c) for c in ("doc_id", "text", "block", "extra"))):
                doc_id, text, place = doc_id.as_py(), text.as_py() or "", (block.as_py(), extra.as_py())
                if last and last[0] == (place[0], 1):
                    continue  # only the first extra row is a neighbour
                own = fingerprint(text.encode())
                if last and last[0][0] == place[0]:
                    rows.append(compared(*last[1:], text, own))
                last = (place, doc_id, text, own)
            yield batch_of(rows)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "") for t in batch.column("text").to_pylist()]
            codes = [fingerprint(t.encode()) for t in texts]
            yield batch_of([compared(None, t, c, t, c) for t, c in zip(texts, codes)])

    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = whole.where("doc_id IS NOT NULL")
    dealt = (with_blocks(named, 4 * tasks(spark)).repartition(tasks(spark), "block")
             .sortWithinPartitions("block", "extra", F.desc("doc_id"), "text"))
    return dealt.mapInArrow(pairs, SCHEMA).unionByName(whole.where("doc_id IS NULL").mapInArrow(alone, SCHEMA))
