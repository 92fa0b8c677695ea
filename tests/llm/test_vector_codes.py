import hashlib
import math
import os
import random

import numpy as np
import pytest

from corpusguard.llm import queries
from corpusguard.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract in plain Python integers, every part against every entry."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept or len(kept[0][1]) % parts:
        return [], hashlib.sha256(b"").hexdigest()
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w:(p + 1) * w] for r in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    out = [(r[0], "".join(f"{found[p][i][1]:02x}" for p in range(parts)), sum(found[p][i][0] for p in range(parts)), r[2]) for i, r in enumerate(kept)]
    by_label = {}
    for _, _, error, label in out:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()

    def fits(v):
        return v if v < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(by_label[label])) for i, c, e, label in out), key=str), digest


def check(spark, rows, schema=SCHEMA, **kw):
    got = V.compress(spark.createDataFrame(rows, schema).repartition(3), **kw)
    told = V.with_label_errors(got.codes).select("vec_id", "code", "error", "label_error").collect()
    want, digest = plain(rows, **kw)
    assert sorted(map(tuple, told), key=str) == want
    assert got.digest() == digest


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_clusters_ties_and_repeats(spark):
    r = random.Random(1)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(r.randint(0, 500), f32([c + r.gauss(0, 0.02) for c in r.choice(centres)]), r.choice([1, 2, None])) for _ in range(700)]
    rows += [(1000 + i, f32([0.25] * 8), 7) for i in range(300)] + [(3, [0.5, -0.5] * 4, 1)] * 5
    check(spark, rows, entries=32)


def test_small_grid_has_many_ties(spark):
    r = random.Random(2)
    rows = [(i, [r.randint(-2, 2) / 1024 for _ in range(8)], i % 3) for i in range(400)]
    check(spark, rows, entries=16)


def test_bad_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan] * 4, 1), (4, [inf] * 4, 1), (None, [0.5, 1.0, 1.5, -2.0], None),
            (5, [0.1, 0.2, 0.3, 0.4], None), (6, [0.1] * 8, 2), (7, [], 3), (8, [0.1] * 3, 3)]
    check(spark, rows)
    check(spark, [(1, [0.5] * 3, 1)])
    check(spark, [(1, [], 1), (2, [], None)])
    check(spark, rows[:4])


def test_numbers_beyond_doubles(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([1e7, -3e6, 5e5]) * r.random() for _ in range(4)], 1) for i in range(60)]
    check(spark, rows, schema="vec_id long, embedding array<double>, label int", entries=8)
    huge = V.compress(spark.createDataFrame([(i, [1e30 * i, 1.0, -1e300, 0.0], 1) for i in range(5)], "vec_id long, embedding array<double>, label int"), entries=2)
    assert huge.codes.count() == 5 and huge.books[2][0][0] == math.floor(-1e300) * 1024


def test_trees_cover_and_separate():
    r = np.random.default_rng(4)
    points = np.floor(r.normal(0, 300, (300, 4))).astype(np.int64)
    points[100:180] = points[7]
    tree = V.CoverTree.from_bytes(V.cover_tree(points).to_bytes())
    assert sorted(tree.order) == list(range(300))
    away = np.sqrt(V.squared(points, points))
    for k in range(len(tree.start)):
        own = tree.order[tree.start[k]:tree.stop[k]]
        assert away[own[0], own].max() <= tree.radius[k] + 1e-9
        kids = range(tree.first[k], tree.first[k] + tree.children[k])
        if len(kids):
            assert [tree.start[k], *(tree.stop[c] for c in kids)] == [*(tree.start[c] for c in kids), tree.stop[k]]
            centres = [tree.order[tree.start[c]] for c in kids]
            scale = 2.0 ** (math.ceil(math.log2(away[own[0], own].max())) - 1)
            assert centres[0] == own[0] and min(away[a, b] for a in centres for b in centres if a != b) > scale
            assert all(tree.radius[c] <= scale * (1 + 1e-9) for c in kids)
        else:
            assert tree.radius[k] == 0
    book = np.floor(r.normal(0, 300, (20, 4))).astype(np.int64)
    start, stop, entry = V.assign(points, tree, book)
    got = np.full(300, -1)
    for a, b, e in zip(start, stop, entry):
        assert (got[tree.order[a:b]] == -1).all()
        got[tree.order[a:b]] = e
    assert (got == V.squared(points, book).argmin(1)).all()
    assert len(start) < 300


def test_clashing_columns_and_empty_table(spark):
    table = spark.createDataFrame([(1, [0.5] * 4, 1, "x", "y")], SCHEMA + ", code string, vector string")
    assert [r.code for r in V.compress(table).codes.collect()] == ["00000000"]
    assert V.with_label_errors(V.compress(table.limit(0)).codes).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_vector_codes"](spark, "/root/testdata/sf0.001").collect()
    want, digest = plain(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want and {r.codebooks_sha256 for r in got} == {digest}
