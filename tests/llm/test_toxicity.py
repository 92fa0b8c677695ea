import random

import pytest

from corpusguard.llm import toxicity as X

CLEAN = ["river", "stone", "walk", "green", "house", "morning", "paper", "table", "music", "window", "garden", "letter", "train", "market"]
BAD = ["grobian", "vilestuff", "nastyword"]


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        words = r.choices(CLEAN, k=r.randint(5, 40))
        if i % 4 == 0:
            words += [w + r.choice(["", "s", "ing"]) for w in r.choices(BAD, k=3)]
        elif i % 4 == 1:
            words += ["killer", "whale"]
        if i % 8 == 0:
            words += ["killer", "fool"]
        if i % 4:
            r.shuffle(words) if i % 4 != 1 else None
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return X.fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_folding():
    assert X.folded("ІDІОТ 1d10t ïdíot ｉｄｉｏｔ i\u200bdiot") == " idiot idiot idiot idiot idiot "
    assert X.folded("L0ser! |oser") == X.folded("loser loser") and X.folded(None) == X.folded("") == "  "


def test_lexicon_and_scores(spark, model):
    for word in BAD:
        assert any(X.folded(word).startswith(e.rstrip()) for e in model.weights)
    texts = ["river stone", "river stone gr0bian nastyword walk", "GROBIANISH vilestuffs and nаstywоrd", "killer whale in the river", "", None,
             "walk " * 30_000]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in X.score_toxicity(docs, model).collect()}
    assert [got[i].predicted for i in range(7)] == [0, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == got[5].score == got[0].score


def test_exception_phrases_spare_matches():
    matcher = X.Matcher({" kiiier": 3.0}, (" kiiier whaie ",))
    assert matcher.hits(X.folded("a killer whale")) == [] and len(matcher.hits(X.folded("a killer. A killer whale. killers"))) == 2


def test_matches_equal_a_plain_search(model):
    r = random.Random(9)
    matcher = X.Matcher(model.weights)
    for _ in range(50):
        text = X.folded(" ".join(r.choices(CLEAN + BAD + ["xgrobian", "grob", "nastywordly"], k=20)))
        want = sorted((i, e) for e in model.weights for i in range(len(text)) if text.startswith(e, i))
        assert sorted(matcher.hits(text)) == want


def test_no_labels_one_kind_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    none = X.fit_toxicity(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert [r.predicted for r in X.score_toxicity(docs, none).collect()] == [0, 0, 0]
    one = X.fit_toxicity(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert all(r.score > 0.99 for r in X.score_toxicity(docs, one).collect())
    assert X.score_toxicity(docs.limit(0), one).collect() == []


def test_folding_of_any_script():
    from corpusguard.llm import toxicity
    for text in ("𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "ᴉdiot", "😀idiot😀", "IDIOT،", "i\u0301d\u200bi0t", "ｉｄｉｏｔ", "1d10t"):
        assert toxicity.folded(text).split()[0] == "idiot", text
    assert toxicity.folded("日本 текст ² ،") == f" 日本 {toxicity.folded('текст').strip()} "
