import hashlib
import random

import numpy as np

from corpusguard.llm import fingerprints as P


def texts(n, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstuvé") for _ in range(r.randint(2, 9))) for _ in range(300)]
    return [" ".join(r.choices(words, k=r.randint(0, 300))) for _ in range(n)]


def test_neighbours_and_edits(spark):
    r = random.Random(1)
    rows = list(zip(r.sample(range(-50, 5000), 200), texts(200)))
    rows += [(6000, None), (6001, "ab"), (6002, "𝒳y")]
    order = sorted(rows, reverse=True)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int").repartition(5)
    got = {x.doc_id: x for x in P.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        codes = [P.fingerprint(t.encode()) for t in (text, edited, following)]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == tuple(map(P.encoded, codes[:2]))
        assert (got[i].near_edited, got[i].near_next) == (P.likeness(codes[0], codes[1]), P.likeness(codes[0], codes[2]))
    closer = [x for x in got.values() if x.n_chars > 300]
    assert sum(x.near_edited > x.near_next for x in closer) > 0.95 * len(closer)


def test_likeness_is_bounded_and_symmetric():
    codes = [P.fingerprint(t.encode()) for t in texts(40, 3)] + [P.fingerprint(b""), P.fingerprint(b"x" * 99999)]
    for a in codes:
        assert P.likeness(a, a) == 1.0
        for b in codes:
            assert 0 <= P.likeness(a, b) <= 1 and P.likeness(a, b) == P.likeness(b, a)
    assert len({P.encoded(c) for c in codes}) == len({tuple(c) for c in codes})


def test_ties_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text of one"), (1, "same text of one"), (1, "other text"), (None, "no id"), (None, None)], "doc_id long, text string")
    got = P.fingerprints(docs).collect()
    assert sorted((x.doc_id or -1, x.n_chars) for x in got) == [(-1, 0), (-1, 5), (1, 10), (1, 16), (1, 16)]
    assert all(x.near_next == 1.0 for x in got if x.doc_id is None)
    assert P.fingerprints(docs.limit(0)).collect() == []
    one = P.fingerprints(docs.where("text = 'other text'")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"otherother").hexdigest() and one[0].near_next == 1.0


def test_equal_texts_have_equal_fingerprints():
    assert (P.fingerprint(b"abc def" * 9) == P.fingerprint(b"abc def" * 9)).all()
    assert np.unique([P.encoded(P.fingerprint(b"abcd"[:n])) for n in range(5)]).size == 5
