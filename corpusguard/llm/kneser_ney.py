"""Interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in memory-mapped arrays.

Counting: tasks cut training texts to words and count pairs of neighbours; the
counts go, packed, to the part that owns the first word. Pairs that start with one of
the few most frequent words are dealt by the whole pair instead, so no word makes a
part large. Each part writes its pairs and contexts as sorted hash arrays to the
shared folder and returns, for every word, how many words it has seen before it;
those continuation counts are summed in Spark and written in the same form.

Scoring: workers map the arrays and look up the distinct words and pairs of a few
megabytes of text at a time, in sorted order.

P(v|u) = (c(uv) - D) / c(u) + (D1 n1 + D2 n2 + D3 n3) / c(u) * P(v), where n1, n2, n3
are the pairs of u seen once, twice, more often, and P(v) is the same form over
continuation counts, with the uniform share of V + 1 words below it; so a word never
seen has a probability too. The discounts come from the counts of counts.

Words are told apart by 64-bit hashes, as second words of pairs by 48 bits.

Nulls and edges: a null text is empty and is one end token. Rows without id are
scored but teach nothing, as their fold is unknown. Repeated rows count and are
scored each. Without training text every token has the probability 1. Other columns
are ignored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import GOLDEN, joined_bytes, mix, slices, tasks, word_hashes
from corpusguard.session import materialized, scratch_path

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
LOW48 = np.uint64((1 << 48) - 1)
CHUNK = 16 << 20
#: A word with more than this share of the tokens is dealt by pairs; so there are fewer than its inverse.
FREQUENT = 0.001
ALPHA = 0.1
PAIRS_OF, CONTEXT, BEFORE = 0, 1, 2


class Arrays:
    """Arrays in a folder that all executors reach; local folders are mapped, others copied to an unnamed local file."""

    def __init__(self, uri: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(uri)
        self.open: dict[str, np.ndarray] = {}

    def save(self, name: str, values: np.ndarray) -> None:
        """Written under another name first, so a task that is repeated does no harm."""
        self.fs.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(pa.py_buffer(np.ascontiguousarray(values)))
        self.fs.move(draft, f"{self.folder}/{name}")

    def load(self, name: str, kind) -> np.ndarray:
        if name not in self.open:
            info = self.fs.get_file_info(f"{self.folder}/{name}")
            if not info.size:
                self.open[name] = np.zeros(0, kind)
            elif isinstance(self.fs, pa.fs.LocalFileSystem):
                self.open[name] = np.memmap(info.path, kind, "r")
            else:
                with tempfile.TemporaryFile() as copy, self.fs.open_input_stream(info.path) as source:
                    while piece := source.read(1 << 22):
                        copy.write(piece)
                    copy.flush()
                    self.open[name] = np.memmap(copy, kind, "r")
        return self.open[name]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, into how many parts, and the numbers that every task needs."""

    uri: str
    parts: int
    tokens: int
    words: int
    kinds: int
    discounts: tuple[float, ...]
    lower: tuple[float, ...]
    lower_rest: float
    frequent: dict[int, tuple[int, ...]]


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each text followed by END, and the places after each END."""
    words, first = word_hashes(*joined_bytes(texts))
    return np.insert(words, first[1:], END), first[1:] + np.arange(1, len(first))


def before(tokens: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The token before each, START at the beginning of a text."""
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    previous[np.concatenate([[0], stops[:-1]])] = START
    return previous


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(u) * GOLDEN + (v & LOW48))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: over all texts of ``docs``, END included."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            word, n = np.unique(np.concatenate([token_stream(b.column("text"))[0] for b in chunk]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": word.astype(np.int64), "n": n})

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order of u: each u once, v in 48 bits, counts in a byte with the large ones apart."""
    new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    large = n >= 255
    return b"".join(x.tobytes() for x in (
        np.asarray([len(u), len(new), large.sum()], np.uint32), u[new], np.diff(np.append(new, len(u))).astype(np.uint32),
        v.astype(np.uint32), ((v & LOW48) >> np.uint64(32)).astype(np.uint16), np.where(large, 255, n).astype(np.uint8), n[large].astype(np.int64)))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, heads, large = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    at, out = 12, []
    for kind, size in ((np.uint64, heads), (np.uint32, heads), (np.uint32, pairs), (np.uint16, pairs), (np.uint8, pairs), (np.int64, large)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    u, each, low, high, n, more = out
    n = n.astype(np.int64)
    n[n == 255] = more
    return np.repeat(u, each), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), n


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name, at = np.unique(key, return_inverse=True)
    return name, np.bincount(at, n, len(name)).astype(np.int64)


def count_pairs(docs: DataFrame, uri: str, parts: int, frequent: np.ndarray) -> DataFrame:
    """Write the arrays of pairs and contexts; return kind, key, n to be summed.

    PAIRS_OF: pairs seen key times (1 to 4). CONTEXT + 10 * slot: tokens and pairs of
    the frequent word ``key``. BEFORE: distinct words before the word ``key``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            u, v = [], []
            for batch in chunk:
                tokens, stops = token_stream(batch.column("text"))
                u.append(before(tokens, stops))
                v.append(tokens)
            u, v = np.concatenate(u), np.concatenate(v)
            keys, first, n = np.unique(pair_keys(u, v), return_index=True, return_counts=True)
            u, v = u[first], v[first]
            common = frequent[np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)] == u if len(frequent) else np.zeros(len(u), bool)
            part = (np.where(common, keys, mix(u)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((u, part))
            u, v, n, part = u[order], v[order], n[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            filled = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
            yield pa.RecordBatch.from_pydict({"part": pa.array(filled, pa.int64()), "blob": pa.array(
                [_pack(*(x[bounds[p]:bounds[p + 1]] for x in (u, v, n))) for p in filled], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, current, blobs = Arrays(uri), None, []

        def answer() -> pa.RecordBatch:
            u, v, n = (np.concatenate(c) for c in zip(*map(_unpack, blobs)))
            keys, first, at = np.unique(pair_keys(u, v), return_index=True, return_inverse=True)
            u, v, n = u[first], v[first], np.bincount(at, n, len(keys)).astype(np.int64)
            arrays.save(f"once-{current}", keys[n == 1])
            arrays.save(f"more-{current}", keys[n > 1])
            arrays.save(f"counts-{current}", n[n > 1])
            name, at = np.unique(u, return_inverse=True)
            slots = np.stack([np.bincount(at, w, len(name)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)])
            common = np.isin(name, frequent)
            arrays.save(f"contexts-{current}", name[~common])
            for i in range(4):
                arrays.save(f"context{i}-{current}", slots[i][~common])
            rows = [(np.full(4, PAIRS_OF), np.arange(1, 5), np.asarray([(n == k).sum() for k in range(1, 5)]))]
            rows += [(np.full(common.sum(), CONTEXT + 10 * i), name[common].astype(np.int64), slots[i][common]) for i in range(4)]
            word, kinds = np.unique(v, return_counts=True)
            rows.append((np.full(len(word), BEFORE), word.astype(np.int64), kinds))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)], ["kind", "key", "n"])

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob")):
                if part != current and blobs:
                    yield answer()
                    blobs = []
                current = part
                blobs.append(blob.as_py())
        if blobs:
            yield answer()

    dealt = (docs.select("text").mapInArrow(count, "part long, blob binary")
             .repartition(tasks(docs.sparkSession), "part").sortWithinPartitions("part"))
    return dealt.mapInArrow(finish, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def save_table(table: DataFrame, uri: str, name: str, parts: int) -> None:
    """Write (key, n) as sorted arrays per part; a part is the key's hash modulo ``parts``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(uri)
        held = [(b.column("key").to_numpy().astype(np.uint64), b.column("n").to_numpy(), b.column("part").to_numpy()) for b in batches]
        if held:
            key, n, part = (np.concatenate(c) for c in zip(*held))
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                own = own[np.argsort(key[own])]
                arrays.save(f"{name}-{p}", key[own])
                arrays.save(f"{name}-n-{p}", n[own])
            yield pa.RecordBatch.from_pydict({"saved": pa.array([len(key)], pa.int64())})

    def add_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = (mix(b.column("key").to_numpy().astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(part)], ["key", "n", "part"])

    placed = table.select("key", "n").mapInArrow(add_part, "key long, n long, part long")
    placed.repartition(tasks(table.sparkSession), "part").mapInArrow(write, "saved long").agg(F.sum("saved")).collect()


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from how many are seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(0, c) for c in counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = [(n2, n1), (n3, n2), (n4, n3)]
    return tuple(min(k, max(0.1, k - (k + 1) * y * a / b)) if b else 0.5 for k, (a, b) in enumerate(ratios, 1))


def train(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` and write the model to the shared folder. The driver holds a few numbers and
    the frequent words, of which there are less than 1 / FREQUENT."""
    spark = docs.sparkSession
    uri, parts = scratch_path(spark, "bigrams"), 2 * tasks(spark)
    words = materialized(word_counts(docs), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    often = words.where(F.col("n") > FREQUENT * total["n"]).select("word").collect()
    frequent = np.unique(np.asarray([r["word"] for r in often], np.int64).astype(np.uint64))
    frequent = np.union1d(frequent, np.asarray([START], np.uint64))
    sums = materialized(count_pairs(docs, uri, parts, frequent), "sums")
    below = sums.where(F.col("kind") == BEFORE)
    save_table(words.withColumnRenamed("word", "key"), uri, "words", parts)
    save_table(below, uri, "before", parts)
    of = {r["key"]: r["n"] for r in sums.where(F.col("kind") == PAIRS_OF).collect()}
    contexts: dict[int, list[int]] = {}
    for r in sums.where(F.col("kind") % 10 == CONTEXT).collect():
        contexts.setdefault(r["key"], [0] * 4)[r["kind"] // 10] = r["n"]
    lower = below.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)],
                      F.count_if(F.col("n") > 2).alias("many")).first()
    d = discounts([lower[f"n{k}"] for k in range(1, 5)])
    rest = (d[0] * lower["n1"] + d[1] * lower["n2"] + d[2] * lower["many"]) / lower["all"] if lower["all"] else 1.0
    return Model(uri, parts, total["n"], total["v"], lower["all"], discounts([of.get(k, 0) for k in range(1, 5)]), d, rest,
                 {k: tuple(v) for k, v in contexts.items()})


class Lookup:
    """Probabilities by the arrays of a model."""

    def __init__(self, model: Model):
        self.m, self.arrays = model, Arrays(model.uri)
        self.frequent = np.asarray(sorted(k & (1 << 64) - 1 for k in model.frequent), np.uint64)
        self.slots = np.asarray([model.frequent[int(k.astype(np.int64))] for k in self.frequent], np.float64).reshape(-1, 4)

    def find(self, name: str, keys: np.ndarray, part: np.ndarray, values: list[str] | None = None, kinds=np.int64) -> np.ndarray:
        """For each key (rising within its part) the values beside it, one row per name of ``values``; 0 if it is absent.
        Without ``values``, 1 if it is there."""
        out = np.zeros((len(values or [1]), len(keys)))
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[p]:bounds[p + 1]]
            there = self.arrays.load(f"{name}-{p}", np.uint64)
            if not len(there):
                continue
            at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
            hit = there[at] == keys[own]
            for row, value in enumerate(values or [None]):
                out[row, own[hit]] = self.arrays.load(f"{value}-{p}", kinds)[at[hit]] if value else 1
        return out

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and lower-order probabilities of distinct rising words."""
        parts = np.uint64(self.m.parts)
        n = self.find("words", words, (mix(words) % parts).astype(np.int64), ["words-n"])[0]
        short, back = np.unique(words & LOW48, return_inverse=True)
        kinds = self.find("before", short, (mix(short) % parts).astype(np.int64), ["before-n"])[0][back]
        uniform = self.m.lower_rest / (self.m.words + 1)
        return n, (kinds - self.discount(kinds, self.m.lower)) / max(1, self.m.kinds) + uniform

    @staticmethod
    def discount(n: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
        return np.where(n > 2, d[2], np.where(n == 2, d[1], np.where(n == 1, d[0], 0.0)))

    def pairs(self, u: np.ndarray, v: np.ndarray, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of distinct pairs with rising keys."""
        parts = np.uint64(self.m.parts)
        place = np.minimum(np.searchsorted(self.frequent, u), max(0, len(self.frequent) - 1))
        common = self.frequent[place] == u if len(self.frequent) else np.zeros(len(u), bool)
        part = (np.where(common, keys, mix(u)) % parts).astype(np.int64)
        n = self.find("once", keys, part)[0] + self.find("more", keys, part, ["counts"])[0]
        name, back = np.unique(u, return_inverse=True)
        slots = self.find("contexts", name, (mix(name) % parts).astype(np.int64), [f"context{i}" for i in range(4)])[:, back]
        if common.any():
            slots[:, common] = self.slots[place[common]].T
        tokens, rest = slots[0], sum(d * s for d, s in zip(self.m.discounts, slots[1:]))
        safe = np.maximum(tokens, 1)
        return np.where(tokens > 0, (n - self.discount(n, self.m.discounts)) / safe + rest / safe * lower, lower)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for chunk in chunks(batches):
            streams = [token_stream(b.column("text")) for b in chunk]
            tokens = np.concatenate([t for t, _ in streams])
            first = np.concatenate([before(t, s) for t, s in streams])
            stops = np.concatenate([s + shift for (_, s), shift in zip(streams, np.cumsum([0] + [len(t) for t, _ in streams]))])
            starts = np.concatenate([[0], stops[:-1]])
            word, of = np.unique(tokens, return_inverse=True)
            n, lower = look.words(word)
            base = np.log10((n + ALPHA) / (model.tokens + ALPHA * (model.words + 1)))
            keys, some, at = np.unique(pair_keys(first, tokens), return_index=True, return_inverse=True)
            p = np.log10(np.minimum(1.0, look.pairs(first[some], tokens[some], keys, lower[of[some]])))
            sums = [np.add.reduceat(x, starts) for x in (base[of], p[at], (n > 0).astype(np.int64)[of])]
            ids = pa.concat_arrays([b.column("doc_id") for b in chunk])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(stops - starts), pa.array(sums[2]), pa.array([model.tokens] * len(ids), pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
