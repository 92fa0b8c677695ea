import random

import numpy as np

from corpusguard.llm import language as L

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["schn", "ung", "keit", "ver"], "cc": ["éau", "oux", "ç", "ment"]}


def text(lang, r, n=30):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_rejection(spark):
    r = random.Random(1)
    train = [(i, text(lang, r, r.choice([3, 30, 100])), lang, "x") for i, lang in enumerate(list(SYLLABLES) * 60)] + [(999, None, "aa", "x"), (998, "zzz", None, "x")]
    model = L.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string, gram string"))
    assert set(model.langs) == set(SYLLABLES) and len(model.langs) > 3
    tests = [(i, text(lang, r), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    extra = [(1000, None), (1001, ""), (1002, "123 !?"), (1003, "Жлъщюф ъщжы " * 9), (1004, text("bb", r, 20_000)), (1004, "ka")]
    got = L.predict_languages(spark.createDataFrame([(i, t) for i, t, _ in tests] + extra, "doc_id long, text string"), model).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert sum(by[i][0].lang_pred == lang for i, _, lang in tests) == len(tests)
    assert not any(by[i][0].rejected for i, _, _ in tests)
    assert [(by[i][0].lang_pred, by[i][0].score, by[i][0].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert by[1003][0].rejected and len(by[1004]) == 2 and all(0 <= x.score <= 1 for x in got)


def test_counts_are_those_of_each_text_alone():
    r = random.Random(2)
    texts = [text("cc", r, 5), None, "", "ÄÖ ab", "1 2 3"]
    together = L.term_counts(texts)
    assert all((L.term_counts([t])[0] == together[i]).all() for i, t in enumerate(texts))
    assert together[0].sum() > 0 and np.delete(together[4], L.BLANKS).sum() == 0


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    assert [(x.lang_pred, x.rejected) for x in L.predict_languages(docs, model).collect()] == [("und", True)]
    assert L.predict_languages(docs.limit(0), model).collect() == []


def test_unlearned_languages_and_random_letters_are_rejected_and_short_clean_texts_stay(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda n: " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n))
    unlearned = lambda n: " ".join("".join(r.choices(["yksi", "puo", "llä", "jär", "hyv"], k=r.randint(1, 4))) for _ in range(n))
    train = [(i, text(lang, r, r.choice([1, 3, 30, 100])), lang) for i, lang in enumerate(list(SYLLABLES) * 200)]
    train += [(1000, "x", "aa"), (1001, noise(40), "bb"), (1002, "Жлъщюф ъщжы", "cc")]  # odd or mislabelled
    model = L.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    clean = [(i, text(lang, r, r.choice([1, 3, 30, 100]))) for i, lang in enumerate(list(SYLLABLES) * 100)]
    odd = [(1000 + i, make(n)) for i, (make, n) in enumerate([(noise, 20), (noise, 200), (unlearned, 20), (unlearned, 200)] * 25)]
    got = {x.doc_id: x.rejected for x in L.predict_languages(spark.createDataFrame(clean + odd, "doc_id long, text string"), model).collect()}
    assert sum(got[i] for i, _ in clean) <= 12 and sum(got[i] for i, _ in odd) >= 98


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(30)] + [(40 + i, f"el gato y la casa {i}", "es") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    odd = spark.createDataFrame([(1, "²½①"), (2, "12 _ ٣"), (3, "\u0301"), (4, "the"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(odd, model).collect()}
    assert got[4] == "en" and {got[k] for k in (1, 2, 3, 5)} == {"und"}


def test_every_row_teaches(spark):
    from pyspark.sql import functions as F
    r = random.Random(5)
    order = [x.id for x in spark.range(900).orderBy(F.xxhash64("id")).collect()]
    late = set(order[-60:])  # ids that hash highest, whose texts are of another kind
    rows = [(i, " ".join(r.choices(["quorv", "xylt", "wumb", "jazk"], k=30)) if i in late else text("aa", r), "aa") for i in range(900)]
    model = L.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    again = L.fit_languages(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5))
    assert model.langs == again.langs and np.allclose(model.centroids, again.centroids, atol=1e-5)
    odd = spark.createDataFrame([(i, " ".join(r.choices(["quorv", "xylt", "wumb", "jazk"], k=30))) for i in range(40)], "doc_id long, text string")
    got = L.predict_languages(odd, model).collect()
    assert min(x.score for x in got) > 0.8 and sum(x.rejected for x in got) <= 4
