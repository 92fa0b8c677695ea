import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusguard.llm import secrets

WORDS = "the of and to in is that it was for on are as with they at be this from have or by one had not but what all were when".split()


def prose(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i // 5 * seed) % len(WORDS)] + (str(seed) if i % 9 == 4 else "") for i in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    item = "What is the name of the long river that runs through the old town of Linden and then on to the sea?"
    rows = [(i, prose(i)) for i in range(20)]
    rows += [(100, prose(3)), (101, prose(4) + " More."), (102, prose(30) + " " + item + " " + prose(31)),
             (103, prose(32) + " token = abcdef123456 " + prose(33)), (104, None), (105, "12345 !!"), (None, prose(34)), (106, prose(35)), (106, prose(35))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    docs = docs.withColumn("_own", F.lit(7)).withColumn("_place", F.lit("p")).withColumn("key", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs.collect()
        docs = P.materialized(stage(spark, docs, tables), name)
        after = docs.collect()
        assert docs.columns == columns
        ids, were = [r.doc_id for r in after], [r.doc_id for r in before]
        if name == "language_id":
            assert set(were) - set(ids) == {104, 105}
        elif name == "near_duplicates":
            for a in after:
                for b in after:
                    if a.doc_id is not None and b.doc_id is not None and a.doc_id < b.doc_id:
                        x, y = shingles(a.text), shingles(b.text)
                        assert 100 * len(x & y) < 75 * len(x | y)
            assert set(were) - set(ids) == {100, 101} and ids.count(106) == 1 and None in ids
        elif name == "decontamination":
            assert set(were) - set(ids) == {102}
        else:
            assert sorted(map(str, ids)) == sorted(map(str, were))
            text = next(r for r in after if r.doc_id == 103)
            assert secrets.MASK in text.text and "abcdef123456" not in text.text and text.n_chars == len(text.text)
    assert P.STAGES[-1][1](spark, docs, tables).select("doc_id").distinct().count() == len({r.doc_id for r in docs.collect()})


def test_run_returns_the_last_stage(spark, tables):
    rows = P.run(spark, tables).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
