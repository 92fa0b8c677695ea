import collections
import math
import re

import numpy as np
import pytest

from corpusguard.llm import kneser_ney as K

TEXTS = ["the cat sat on the mat", "the cat ran", "A dog sat on THE cat\tthe\nmat", "a dog ran on the mat", "", "the the the cat", "dog cat dog cat mat",
         "a cat sat", "the mat sat on a dog and ran", None, "a a b b c c d d the", "on the mat the cat and the dog"]
OTHERS = ["the cat sat", "zebra", None, "the unknown cat", "mat on the"]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def plain(train, texts):
    """The model as it is defined, from plain counts."""
    pairs, words = collections.Counter(), collections.Counter()
    for t in train:
        ws = tokens(t)
        words.update(ws)
        pairs.update(zip(["<s>", *ws], ws))

    def d(values):
        c = collections.Counter(values)
        return K.discounts([c[k] for k in range(1, 5)])

    def off(n, ds):
        return ds[min(n, 3) - 1] if n else 0
    kinds = collections.Counter(v for _, v in pairs)
    high, low = d(pairs.values()), d(kinds.values())
    rest = sum(off(n, low) for n in kinds.values()) / len(pairs)
    total = sum(words.values())

    def lower(v):
        return (kinds[v] - off(kinds[v], low)) / len(pairs) + rest / (len(words) + 1)

    def prob(u, v):
        after = [n for (a, _), n in pairs.items() if a == u]
        if not after:
            return lower(v)
        return (pairs[u, v] - off(pairs[u, v], high)) / sum(after) + sum(off(n, high) for n in after) / sum(after) * lower(v)
    out = []
    for t in texts:
        ws = tokens(t)
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in ws)
        out.append((len(ws), sum(words[w] > 0 for w in ws), total, base, sum(math.log10(prob(u, w)) for u, w in zip(["<s>", *ws], ws))))
    total_p = [sum(prob(u, v) for v in words) + prob(u, "?") for u in ("the", "<s>", "nowhere")]
    return out, total_p


def test_equals_plain_counts(spark):
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    every = TEXTS + OTHERS
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(every)], "doc_id long, text string, n long")
    got = {r.doc_id: r for r in K.score(docs, K.train(train)).collect()}
    want, sums = plain(TEXTS, every)
    assert sums == pytest.approx([1.0] * 3)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == pytest.approx(w[3:], rel=1e-9)


def test_frequent_words_and_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.pareto(0.6, 200)) for _ in range(60)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(K, "CHUNK", 2000)
    got = {r.doc_id: r.score for r in K.score(train, K.train(train)).collect()}
    want, _ = plain(texts, texts)
    assert [got[i] for i in range(60)] == pytest.approx([w[4] for w in want], rel=1e-9)


def test_empty_training_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = K.train(docs.limit(0))
    assert K.score(docs.limit(0), model).collect() == []
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in K.score(docs, model).collect()) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_packing_round_trip():
    u, v = np.asarray([3, 3, 9], np.uint64), np.asarray([1, (1 << 48) - 1, 7], np.uint64)
    n = np.asarray([1, 254, 70_000])
    assert all((a == b).all() for a, b in zip(K._unpack(K._pack(u, v, n)), (u, v, n)))
