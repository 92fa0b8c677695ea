import hashlib
import re

from corpusguard.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    """The base spans, told from the patterns as they are stated."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


HEX30, KEY = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8
TEXTS = [
    None, "", "   ", "plain words only",
    "token=abcde", "token==abcdef", "token: token:abcdefgh", "TOKEN = 'abc.def=' x", 'api_key": "zzzzzz" apikey=yyyyyyy',
    f"é token={HEX30} ü", f"{KEY} {HEX30}", "AKIA" + "A" * 15, "XAKIA" + "B" * 16, f"password=\"{KEY}\"", "secret=" + "q" * 70_000,
    "login: bob123 then a1B2c3D4e5F6g7H8i9J0k and no more", "login: bob123 " + "w " * 300 + "a1B2c3D4e5F6g7H8i9J0k",
    "see https://db.example.org/x today", f"https://db.example.org/x user_name=anna {HEX30}", "passwd=𝒳abcdef passwd=abcdef𝒳 𝒳token=abcdefg",
]


def test_base_spans_match_the_stated_patterns(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in S.scan_secrets(documents(rows)).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, text in rows:
        want = base(text or "")
        said = ",".join(f"{S.KINDS[k][0]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))


def test_weak_parts_need_a_complement_in_reach(spark, documents):
    near, far = TEXTS[15], TEXTS[16]
    rows = {r.doc_id: r.spans for r in S.scan_secrets(documents([(1, near), (2, far), (3, TEXTS[17]), (4, TEXTS[18])])).collect()}
    assert rows[1] == f"identifier:0:13,mixed:{near.index('a1B2')}:{near.index('a1B2') + 21}"
    assert rows[2] == "" and rows[3] == ""
    assert [s.split(":")[0] for s in rows[4].split(",")] == ["address", "identifier", "hex"]


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, KEY, "a"), (None, KEY, "b"), (5, KEY, "c"), (5, KEY, "c"), (5, "none", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").withColumn("kind", docs_column("x")).withColumn("start", docs_column("y"))
    got = sorted((r.doc_id or -1, r.n_access) for r in S.scan_secrets(docs).collect())
    assert got == [(-1, 1), (-1, 1), (5, 0), (5, 1), (5, 1)]


def docs_column(value):
    from pyspark.sql import functions as F
    return F.lit(value)


def test_empty_table(spark, documents):
    assert S.scan_secrets(documents([])).collect() == []
    assert S.mask_secrets(documents([])).collect() == []


def test_masking_keeps_rows_and_cuts_spans(spark, documents):
    text = f"a token={KEY} b {HEX30}"
    got = {r.doc_id: (r.text, r.n_chars) for r in S.mask_secrets(documents([(1, text), (2, "clean"), (3, None)])).collect()}
    assert got == {1: (f"a {S.MASK} b {S.MASK}", len(f"a {S.MASK} b {S.MASK}")), 2: ("clean", 5), 3: (None, None)}


def test_masking_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(5, f"a {KEY}", 7, "x", 9), (6, "plain", 8, "y", 5)], "doc_id long, text string, _own long, _cuts string, n_chars long")
    got = sorted(map(tuple, S.mask_secrets(docs).collect()))
    assert got == [(5, f"a {S.MASK}", 7, "x", 2 + len(S.MASK)), (6, "plain", 8, "y", 5)] and S.mask_secrets(docs).columns == docs.columns
