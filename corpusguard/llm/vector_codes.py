"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds over partition-local cover trees.

Components become the integers ``floor(1024 * x)`` and vectors are cut into equal parts, each
with a codebook that starts as the parts of the vectors with the least ids. Every task cuts
its vectors into blocks and builds, once, a cover tree per block and part: the children of
a node lie within half its scale and apart from each other, a node's points are neighbours
in the tree's order, and so the difference of two cumulative sums is the sum of a subtree.
In a round, a node whose centre is nearer to one entry than to any other by more than
twice the node's radius gives all its points to that entry; only the others descend, and
where few points are left, or the radius is 0, distances are compared exactly, ties going
to the lower index. Only sums per entry leave a task. The codebooks, of a fixed size, are
all the driver sees. All arithmetic is exact: floats are used as long as they hold every
integer that arises, Python's integers beyond.

Nulls and edges: vectors that are null or hold a null or non-finite component are dropped, and
so are those whose length is not that of the first kept one or cannot be cut equally. Vectors
are ordered by id, null ids last, equal ids by their components; repeated rows are coded
each. With fewer vectors than entries the codebooks are shorter. An empty table gives no
rows. Null labels count as one label. Errors beyond a long are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.session import materialized

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of one block, and points of an undecided node that are compared at once.
BLOCK, FEW = 512, 16
#: Integers of this size and all sums of their squares in a part are exact in a double.
EXACT = float(1 << 52)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as int64 or, where they do not fit, as Python integers."""
    if not values.size or np.abs(values).max() < 2.0 ** 40:
        return np.floor(values * SCALE).astype(np.int64)
    whole = [math.floor(x) if abs(x) >= 2.0 ** 53 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    scaled = [w * SCALE if abs(x) >= 2.0 ** 53 else w for w, x in zip(whole, values.ravel().tolist())]
    return np.array(scaled + [None], object)[:-1].reshape(values.shape)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    if points.dtype != object and entries.dtype != object:
        size = sum(float(np.abs(a).max(initial=0)) for a in (points, entries))
        if points.shape[1] * size * size < EXACT:
            p, e = points.astype(np.float64), entries.astype(np.float64)
            return (p * p).sum(1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(1)[None]
    p, e = points.astype(object), entries.astype(object)
    out = np.zeros((len(p), len(e)), object)
    for k in range(p.shape[1]):
        out += (p[:, k, None] - e[None, :, k]) ** 2
    return out


@dataclass
class CoverTree:
    """``order`` puts the points of each node side by side, its centre first; node k has the points start[k]:stop[k] of it and
    the children first[k]:first[k] + children[k]. Radii are rounded up."""
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    children: np.ndarray
    radius: np.ndarray

    def to_bytes(self) -> bytes:
        arrays = [np.asarray([len(self.order), len(self.start)], "<i4"), *(a.astype("<i4") for a in (self.order, self.start, self.stop, self.first, self.children))]
        return b"".join(a.tobytes() for a in arrays) + self.radius.astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        n, nodes = np.frombuffer(data, "<i4", 2).tolist()
        rest = np.frombuffer(data, "<i4", n + 4 * nodes, 8)
        cuts = np.split(rest, [n, n + nodes, n + 2 * nodes, n + 3 * nodes])
        return cls(*cuts, np.frombuffer(data, "<f8", nodes, 8 + 4 * len(rest)))


def cover_tree(points: np.ndarray) -> CoverTree:
    """The cover tree of a block. Each level halves the scale; levels on which a node would have one child are left out."""
    n = len(points)
    exact = squared(points, points)
    if exact.dtype == object:  # too large for doubles: one node that decides nothing
        return CoverTree(np.arange(n), *(np.asarray([v]) for v in (0, n, 0, 0)), np.asarray([np.inf]))
    apart = np.sqrt(exact)
    order = np.arange(n)
    start, stop, first, children, radius = [0], [n], [0], [0], [0.0]
    k = 0
    while k < len(start):
        a, b = start[k], stop[k]
        mine = order[a:b].copy()
        far = apart[mine[0], mine]
        reach = float(far.max())
        radius[k] = reach * (1 + 1e-12)
        if reach > 0:
            scale = 2.0 ** (math.ceil(math.log2(reach)) - 1)
            near = far <= scale
            groups, rest = [mine[near]], mine[~near]
            while len(rest):
                near = apart[rest[0], rest] <= scale
                groups.append(rest[near])
                rest = rest[~near]
            order[a:b] = np.concatenate(groups)
            first[k], children[k] = len(start), len(groups)
            for g in groups:
                start.append(a)
                a += len(g)
                stop.append(a)
                first.append(0)
                children.append(0)
                radius.append(0.0)
        k += 1
    return CoverTree(order, *(np.asarray(v) for v in (start, stop, first, children)), np.asarray(radius))


def assign(points: np.ndarray, tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, stop, entry) of the tree's order that cover all points, each nearest to its entry."""
    starts, stops, chosen = [], [], []
    nodes = np.zeros(1, np.int64)
    while len(nodes):
        a, b = tree.start[nodes], tree.stop[nodes]
        d = squared(points[tree.order[a]], entries)
        best = d.argmin(1)
        if d.dtype == object:
            sure = tree.radius[nodes] == 0
        else:
            least = np.sqrt(d[np.arange(len(d)), best])
            d[np.arange(len(d)), best] = np.inf
            gap = np.sqrt(d.min(1)) - least
            sure = (tree.radius[nodes] == 0) | (gap > 2 * tree.radius[nodes] * (1 + 1e-9) + 1e-6)
        starts.append(a[sure])
        stops.append(b[sure])
        chosen.append(best[sure])
        few = ~sure & ((b - a <= FEW) | (tree.children[nodes] == 0))
        if few.any():
            at = np.concatenate([np.arange(i, j) for i, j in zip(a[few], b[few])])
            starts.append(at)
            stops.append(at + 1)
            chosen.append(squared(points[tree.order[at]], entries).argmin(1))
        down = nodes[~sure & ~few]
        nodes = np.concatenate([np.arange(tree.first[k], tree.first[k] + tree.children[k]) for k in down]) if len(down) else down
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(chosen)


def cumulative(points: np.ndarray) -> np.ndarray:
    """Sums of the first k points, k from 0; exact."""
    if points.dtype != object and float(np.abs(points).max(initial=0)) * len(points) >= 2.0 ** 62:
        points = points.astype(object)
    return np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points, axis=0)])


def _stored(points: np.ndarray) -> tuple[bytes | None, list[str] | None]:
    return (points.astype("<i8").tobytes(), None) if points.dtype != object else (None, [str(v) for v in points.ravel().tolist()])


def _read(row: dict) -> np.ndarray:
    n = len(row["vec_ids"])
    flat = np.frombuffer(row["points"], "<i8") if row["points"] is not None else np.array([int(v) for v in row["wide"]] + [None], object)[:-1]
    return flat.reshape(n, -1) if n and len(flat) else flat.reshape(n, 0)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            cut = batch.slice(at, BLOCK)
            n = cut.num_rows
            column = cut.column("vector")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            points = integers(values.reshape(n, len(values) // n))
            trees = [cover_tree(p).to_bytes() for p in np.split(points, parts, axis=1)]
            plain, wide = _stored(points)
            row = {"points": [plain], "wide": [wide], "trees": [trees]}
            ids, labels = (pa.ListArray.from_arrays([0, n], cut.column(c)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([ids, labels, *(pa.array(v, schema.field(k).type) for k, v in row.items())], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The number and the sum of the points of each entry, over all blocks of a task."""
    counts = [np.zeros(len(b), np.int64) for b in books]
    totals = [np.zeros(b.shape, object) for b in books]
    for row in _rows(batches):
        for p, part in enumerate(np.split(_read(row), len(books), axis=1)):
            tree = CoverTree.from_bytes(row["trees"][p])
            start, stop, entry = assign(part, tree, books[p])
            running = cumulative(part[tree.order])
            held = running[stop] - running[start]
            own = np.zeros(books[p].shape, held.dtype)
            np.add.at(own, entry, held)
            totals[p] += own.astype(object)
            np.add.at(counts[p], entry, stop - start)
    out = [{"part": p, "entry": int(e), "n": int(counts[p][e]), "sums": [str(v) for v in totals[p][e]]}
           for p in range(len(books)) for e in np.flatnonzero(counts[p])]
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=SUMS)


def _merged(rows):
    """The sums of one entry over all tasks."""
    import pandas as pd
    sums = [sum(column) for column in zip(*([int(v) for v in s] for s in rows["sums"]))]
    return pd.DataFrame({"part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "n": [int(rows["n"].sum())], "sums": [[str(v) for v in sums]]})


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            row = one.drop_columns(["label"]).to_pylist()[0]
            n = len(row["vec_ids"])
            digits, error = [], np.zeros(n, object)
            for p, part in enumerate(np.split(_read(row), len(books), axis=1)):
                tree = CoverTree.from_bytes(row["trees"][p])
                entry = np.zeros(n, np.int64)
                start, stop, chosen = assign(part, tree, books[p])
                by_place = np.argsort(start)
                entry[tree.order] = np.repeat(chosen[by_place], (stop - start)[by_place])
                off = part.astype(object) - books[p][entry].astype(object)
                error += (off * off).sum(1) if off.shape[1] else 0
                digits.append([f"{v:02x}" for v in entry.tolist()])
            codes = ["".join(c) for c in zip(*digits)]
            errors = [int(v) if v < 1 << 63 else None for v in error]
            yield pa.RecordBatch.from_arrays([one.column("vec_ids").flatten(), one.column("label").flatten(), pa.array(codes), pa.array(errors, pa.int64())],
                                             schema=schema)


@dataclass
class Compression:
    """``codes``: vec_id, label, code, error. ``books``: per part the final entries."""
    codes: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def _book(rows: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(v) < 1 << 62 for r in rows for v in r)
    if not rows or not width:
        return np.zeros((len(rows), width), np.int64)
    return np.array(rows, np.int64) if small else np.array(rows, object)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compression:
    """Fit ``parts`` codebooks of ``entries`` entries to ``vectors`` (vec_id, embedding, label) in ``rounds`` rounds and code every vector."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    kept = kept.where(F.col("vector").isNotNull()).where(finite)
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*order).select(F.size("vector").alias("n")).head()
    size = first["n"] if first and first["n"] % parts == 0 else 0
    kept = kept.where(F.size("vector") == (size if first and first["n"] % parts == 0 else -1))
    width = size // parts
    start = [integers(np.asarray(r["vector"], np.float64)).tolist() for r in kept.orderBy(*order).limit(entries).select("vector").collect()]
    books = [_book([v[p * width:(p + 1) * width] for v in start], width) for p in range(parts)]

    from pyspark.sql.pandas.types import to_arrow_schema
    spark_schema = kept.select(F.array("vec_id").alias("vec_ids"), F.array("label").alias("label"), F.lit(b"").alias("points"),
                               F.array(F.lit("")).alias("wide"), F.array(F.lit(b"")).alias("trees")).schema
    for field in spark_schema.fields:
        field.nullable = True
        if hasattr(field.dataType, "containsNull"):
            field.dataType.containsNull = True
    arrow = to_arrow_schema(spark_schema)
    blocks = materialized(kept.mapInArrow(lambda batches: _blocks(batches, parts, arrow), spark_schema), "blocks")
    for _ in range(rounds):
        found = books
        sums = (blocks.mapInArrow(lambda batches: _sums(batches, found), "part int, entry int, n long, sums array<string>")
                .groupBy("part", "entry").applyInPandas(_merged, "part int, entry int, n long, sums array<string>"))
        fresh = [b.tolist() for b in books]
        for r in sums.collect():  # one row per entry
            fresh[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["sums"]]
        books = [_book(b, width) for b in fresh]
    last = books
    coded = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    out = to_arrow_schema(coded)
    codes = blocks.mapInArrow(lambda batches: _codes(batches, last, out), coded)
    return Compression(materialized(codes, "codes"), books)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over equal labels, nulls together. Sums combine before they shuffle."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
