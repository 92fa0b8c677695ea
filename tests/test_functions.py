"""Helpers against plain Python, and skew-safe operators against their plain forms."""

import posixpath
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusguard.functions import lexical as L, skew, text as T
from corpusguard.functions.layout import statements


def test_content_key_is_the_utf16_hash(spark):
    def expected(s):
        units = s.encode("utf-16-le")
        h = 0
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
        return f"{len(units) // 2}:{h - (1 << 32) if h >= 1 << 31 else h}"
    texts = ["", "a", "hello world", "é ü", "smile 😀 end", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.content_key(F.col("s")).alias("k")).collect()
    assert all(r.k == expected(r.s) for r in rows)


def test_fold_path(spark):
    random.seed(1)
    paths = ["/".join(random.choice(["a", "b", ".", "..", "", "c.d"]) for _ in range(random.randint(1, 8))) for _ in range(200)]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.fold_path(F.col("p")).alias("f")).collect()
    for r in rows:
        assert r.f == posixpath.normpath("/" + r.p).lstrip("/")


def test_trim_and_blank(spark):
    row = spark.createDataFrame([("\t ﻿ x y  \r\n",)], "s string").select(
        T.full_trim(F.col("s")).alias("t"), T.not_blank(F.col("s")).alias("n"), T.not_blank(F.lit(" \t")).alias("b")).first()
    assert (row.t, row.n, row.b) == ("x y", True, False)


def test_params(spark):
    cases = {"a, b = 2, ...rest": ["a", "b", "...rest"], "{ a, b: { c } }, [x, y]": ["{...}", "[...]"], "{ a } = {}": [],
             "user: Map<string, User>, cb?: (e: E) => void": ["user", "cb"], "": [], "opts = { a: [1, 2] }": ["opts"]}
    heads = [(k, statements(f"function f({k}) {{")[0].head) for k in cases]
    rows = spark.createDataFrame(heads, "p string, head string").select("p", L.params(F.regexp_extract("head", L.PARAMS, 1)).alias("n")).collect()
    assert {r.p: list(r.n) for r in rows} == cases


def test_lookup_join_with_hot_keys_equals_the_plain_join(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    plain = left.join(right, "k", "left").select("id", "k", "v").collect()
    for hot_rows in (30, 300, 5000):
        salted = skew.lookup_join(left, right, ["k"], hot_rows=hot_rows)
        assert sorted(salted.select("id", "k", "v").collect(), key=str) == sorted(plain, key=str)
    assert [tuple(r) for r in skew.hot_keys(left.where("k IS NOT NULL"), ["k"], 300).collect()] == [("hot", 4)]
    assert skew.hot_keys(left, ["k"], 5000).isEmpty()


def test_lookup_join_leaves_null_keys_where_they_are(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("k"))
    joined = skew.lookup_join(left, spark.createDataFrame([("10", 1)], "k string, v int"), ["k"])
    assert joined.count() == 20_000 and joined.where("v = 1").count() == 1
    plan = joined._jdf.queryExecution().toString()
    assert "isnotnull(k" in plan and "Union" in plan


def test_number_rows_equals_row_number(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.floor(F.rand(3) * 10000).alias("o"))
    df = spark.createDataFrame(df.collect(), df.schema)
    got = skew.number_rows(df, ["g"], ["o", "id"], "n")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")) - 1)
    assert got.join(want, ["id", "g", "o"]).where("n <> w").count() == 0 and got.count() == 5000


def test_number_rows_spreads_one_group(spark):
    """Nearly all rows in one group with sparse order keys, null groups and equal rows; windows see a row per range at most."""
    rows = [("hot", i * 7919 % 100_003 * 10_000_019, i) for i in range(20_000)] + [(None, 1, 1)] * 3 + [("b", None, 5), ("b", 2, None)]
    df = spark.createDataFrame(rows, "g string, o bigint, id int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = skew.number_rows(df, ["g"], ["o", "id"], "n")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_group = {}
    for r in got.collect():
        by_group.setdefault(r.g, []).append(((r.o is not None, r.o or 0, r.id is not None, r.id or 0), r.n))
    assert {g: len(v) for g, v in by_group.items()} == {"hot": 20_000, None: 3, "b": 2}
    for found in by_group.values():
        assert [n for _, n in sorted(found)] == list(range(len(found)))
    ranges = spark.read.parquet(*[f for f in got.inputFiles()]).groupBy("_range").count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 10_000
    empty = skew.number_rows(df.limit(0), ["g"], ["o", "id"], "n")
    assert empty.columns == ["g", "o", "id", "n"] and empty.collect() == []


def test_first_distinct(spark):
    rows = [("a", 5, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 3, ""), ("a", 4, None), ("a", 9, "z"), ("b", 1, "q")]
    df = spark.createDataFrame(rows, "g string, o int, v string")
    got = {r.g: list(r.vs) for r in skew.first_distinct(df, ["g"], "v", ["o"], 2, "vs").collect()}
    assert got == {"a": ["y", "x"], "b": ["q"]}
    everything = {r.g: list(r.vs) for r in skew.first_distinct(df, ["g"], "v", ["o"], 10, "vs").collect()}
    assert everything["a"] == ["y", "x", "z"]


def test_words_use_ascii_boundaries(spark):
    df = spark.createDataFrame([("a token b",), ("étoken",), ("tokens",), ("my_token",), ("token",), ("(jwt)",)], "s string")
    assert [r[0] for r in df.select(T.has_word(F.col("s"), "jwt", "token")).collect()] == [True, True, False, False, True, True]


def test_white_space_members_match_the_class(spark):
    from corpusguard.rules import W
    rows = (spark.range(1, 0xD800).select(F.expr("char(id)").alias("_"), F.col("id"))
            .select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c")))
    by_class = {r.id for r in rows.where(F.col("c").rlike(f"^{W}$")).collect()}
    by_trim = {r.id for r in rows.where(T.full_trim(F.col("c")) == "").collect()}
    assert by_class == by_trim and 0xA0 in by_trim


def test_long_lines_stay_linear(spark):
    lines = ["a('" + "\\n" * 200_000 + "'); b(c)", "x" * 400_000 + " d(e)", " " * 400_000 + "x" + " " * 400_000, "'" + "y" * 300_000]
    rows = spark.createDataFrame([(s,) for s in lines], "s string").select(
        L.called_names(F.col("s")).alias("n"), F.length(T.full_trim(F.col("s"))).alias("t")).collect()
    assert [list(r.n) for r in rows] == [["a", "b"], ["d"], [], []]
    assert rows[2].t == 1
