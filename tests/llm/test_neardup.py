import random
import re

import numpy as np
import pyarrow as pa

from corpusguard.llm import neardup as N
from corpusguard.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=40))
    rows = []
    for g in range(12):
        text = r.choices(vocabulary, k=r.choice([4, 30, 120, 300]))
        for c in range(r.choice([1, 2, 6, 14])):
            copy = list(text)
            for _ in range(r.choice([0, 1, 2, 4, 9])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if c % 3 == 2:
                text = copy  # chains of copies
            rows.append(" ".join(copy) + (" " + passage if g % 4 == 0 else ""))
    rows += ["", None, "  \t\n", "one two", "ONE\u000btwo", "one two three", "a b c d e f g", "x " * 20_000]
    r.shuffle(rows)
    return [(i * 7 % 211, t) for i, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, cls int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_null_ids_repeated_rows_shared_ids_and_empty_table(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    docs = spark.createDataFrame([(5, a), (5, a), (None, a), (7, a), (9, b), (7, b), (8, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [(-1, 3, None, True), (5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (7, 3, 5, False), (8, 1, 8, True), (9, 3, 5, False)]
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_registers_estimate_and_merge():
    r = np.random.default_rng(1)
    for shared in (0.1, 0.5, 0.75, 0.95):
        both, one, two = (np.unique(r.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in (2000 * shared, 1000 * (1 - shared), 1000 * (1 - shared)))
        a, b = np.union1d(both, one), np.union1d(both, two)
        regs = N.sketches([a, b, np.union1d(a, b), a[:0]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        estimate = N.estimated_jaccard(regs[:1], regs[1:2], np.asarray([float(len(a))]), np.asarray([float(len(b))]))[0]
        assert abs(estimate - true) < 5 * (true * (1 - true) / N.REGISTERS) ** 0.5 + 0.01
        assert (np.maximum(regs[0], regs[1]) == regs[2]).all() and not regs[3].any()


def test_sketch_does_not_depend_on_the_batch():
    texts = [t for _, t in corpus()]
    together = N.sketches(N.shingle_sets(pa.array(texts)))
    for i in (0, 3, 11):
        assert (N.sketches(N.shingle_sets(pa.array([texts[i]]))) == together[i]).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(5000, 5001), (5001, 5000), (6000, 6000)]
    edges = spark.createDataFrame(chain + star + loose, "a long, b long")
    got = {r.v: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
    assert components(edges.limit(0)).collect() == []
