import hashlib
import os
import random
import time

import numpy as np

from corpusguard.llm import substrings as S


def brute(rows, length=S.LENGTH):
    first = {}
    bodies = {i: (t or "").encode() for i, t in rows}
    for i in sorted(bodies):
        for p in range(len(bodies[i]) - length + 1):
            first.setdefault(bodies[i][p:p + length], i)
    out = {}
    for i, body in bodies.items():
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if first[body[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(body)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(body, gone) if not g)).hexdigest())
    return out


def corpus(seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé ") for _ in range(r.randint(1, 7))) for _ in range(40)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(r.randint(8, 40)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += [s[a:a + r.randint(20, len(s))], text(r.randint(0, 20))]
        rows.append((i * 3 % 151, "".join(parts)))
    rows += [(200, rows[4][1]), (201, rows[4][1] + "x"), (202, "a" * 400), (203, "b" + "a" * 300 + "c"), (204, "ab" * 200), (205, "b" + "ab" * 90),
             (206, None), (207, ""), (208, "x" * 49), (209, "x" * 49), (210, "x" * 50), (211, "x" * 50), (212, "long " * 60_000)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 5000


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "some words that are long enough to be a string of fifty bytes and more"
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, text, 0), (None, text, 0), (3, "zz", 0), (3, "aa", 0)], "doc_id long, text string, at long")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == [(-1, len(text), 0), (1, len(text), 0), (2, len(text), len(text)), (3, 2, 0)]
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_colliding_hashes_are_told_apart(monkeypatch):
    body = np.frombuffer(b"p" * 60 + b"q" * 60, np.uint8)
    monkeypatch.setattr(S.Prefixes, "part", lambda self, lo, hi: np.zeros(len(lo), np.uint64))
    starts, group, ids = np.asarray([0, 60]), np.asarray([0, 0]), np.asarray([1, 2])
    assert S.repeated(body, starts, group, ids).tolist() == [False, False]


def test_suffix_order_sorts_within_groups():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[500:900] = data[100:500]
    starts = r.permutation(2900)[:700]
    group = np.sort(r.integers(0, 9, 700))
    order = S.suffix_order(data, S.Prefixes(data), starts, group)
    strings = [(g, data[s:s + S.LENGTH].tobytes()) for g, s in zip(group, starts[order])]
    assert strings == sorted(strings) and sorted(order) == list(range(700))


def test_grams_with_many_contexts_are_not_held_whole(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh ", k=60))
    passage, tails = word() + word(), [word() for _ in range(25)]
    rows = corpus() + [(1000 + i, word() + passage + r.choice(tails) + word()) for i in range(120)]
    whole, met = S.compared, []

    def watched(found):
        met.append(max((x["count"] for x in found.groupBy("gram").count().collect()), default=0))
        return whole(found)
    monkeypatch.setattr(S, "compared", watched)
    monkeypatch.setattr(S, "HOT", 10, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(docs).collect()}
    assert got == brute(rows) and max(met) <= 10


def results(docs):
    return {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(docs).collect()}


def test_contexts_that_meet_many_others_take_few_rows_and_no_table_outlives_its_readers(spark, monkeypatch):
    r = random.Random(11)
    word = lambda n=60: "".join(r.choices("abcdefgh ", k=n))
    passage = word() + word()
    # a passage that goes on differently in each document, and long runs of one word in a document
    rows = [(i, word(80) + passage + word(80)) for i in range(150)] + [(200 + i, word(20) + "the " * 300 + word(20)) for i in range(8)]
    written, real = [], S.materialized

    def noted(df, label="table", *a, **k):
        out = real(df, label, *a, **k)
        written.append((label, out.count(), out._scratch))
        return out
    monkeypatch.setattr(S, "materialized", noted)
    monkeypatch.setattr(S, "HOT", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert results(docs) == brute(rows)
    contexts = next(n for label, n, _ in written if label == "contexts")
    assert contexts < 1000 and max(n for label, n, _ in written if label not in ("anchors", "contexts", "stretches")) <= 6 * contexts
    folder = spark._jvm.org.apache.hadoop.fs.Path(written[0][2]).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    left = {label for label, _, path in written if folder.exists(spark._jvm.org.apache.hadoop.fs.Path(path))}
    assert left == {"anchors", "stretches"}


def test_surroundings_are_the_strings_of_an_anchor():
    r = np.random.default_rng(3)
    for letters in (1, 2, 3, 26):
        texts = [bytes(r.integers(97, 97 + letters, n).astype(np.uint8)) for n in (0, 49, 50, 51, 200, 50, 400, 30, 90)]
        texts += [b"ab" * 60 + texts[4] + b"ab" * 60, texts[4]]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        least = S.least_grams(S.gram_hashes(data))
        at, grams, text, lo, hi = S.anchors(data, ends)
        begin = np.concatenate([[0], ends])
        got, want = set(), set()
        for p, g, t, a, b in zip(at, grams, text, lo, hi):
            got |= {(s, p) for s in range(a, b - S.LENGTH + 1)}
            want |= {(s, p) for s in range(max(begin[t], p - S.SPAN + 1), min(p, ends[t] - S.LENGTH) + 1) if least[s] == g}
        assert got == want
        assert {s for s, _ in got} == {s for t, n in enumerate(ends) for s in range(begin[t], n - S.LENGTH + 1)}


def test_pack_keeps_what_it_is_given():
    r = np.random.default_rng(4)
    ids = np.sort(r.choice(np.asarray([-2**62, -5, 0, 1, 70_000, 2**40, 2**62]), 300))
    places = np.concatenate([np.sort(r.integers(0, 2**31 - 1, n)) for n in np.unique(ids, return_counts=True)[1]])
    given = (ids, places, r.integers(0, 1 << 40, 300).astype(np.uint64), r.integers(0, 1 << 48, 300).astype(np.uint64),
             *(r.integers(0, 1 << 16, 300).astype(np.uint16) for _ in range(2)), *(r.integers(0, 35, 300).astype(np.uint8) for _ in range(2)))
    for got, want in zip(S.unpack(S.pack(*given)), given, strict=True):
        assert (got == want).all()


def test_stretches_that_touch_are_one():
    ids, lo, hi = S.merged(np.asarray([2, 1, 2, 2, 1, 1]), np.asarray([5, 0, 0, 90, 40, 60]), np.asarray([80, 50, 9, 95, 45, 70]))
    assert list(zip(ids, lo, hi)) == [(1, 0, 50), (1, 60, 70), (2, 0, 80), (2, 90, 95)]
    assert [len(x) for x in S.merged(*(np.zeros(0, np.int64),) * 3)] == [0, 0, 0]


def test_shuffle_files_of_a_freed_table_go_when_it_is_written(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in blocks for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, was = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = S.materialized(spark.range(1000).repartition(3, "id"), "numbers", freed=True)
    ends = time.time() + 30
    while files() - before and time.time() < ends:
        time.sleep(0.2)
    assert not files() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
