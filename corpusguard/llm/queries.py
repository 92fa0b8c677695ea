"""One query per operator, with production parameters, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm import common, conversations, decontaminate, fingerprints, html_text, kneser_ney, language, neardup, packing, secrets, substrings, toxicity, urls, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark, d):
    return common.table(spark, d, "documents")


@query
def op6_language_id(spark, d):
    docs = documents(spark, d)
    held_out = F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False))
    model = language.fit_languages(docs.where(common.fold("doc_id", 4) != 2))
    return language.predict_languages(docs, model).withColumn("held_out", held_out)


@query
def op1_decontamination(spark, d):
    """One row per document and benchmark item that leaks into it; clean documents have none."""
    return decontaminate.find_leaks(documents(spark, d), common.table(spark, d, "benchmark")).drop("h").distinct()


@query
def op2_url_filter(spark, d):
    return urls.filter_urls(common.table(spark, d, "pages"))


@query
def op3_toxicity(spark, d):
    docs = documents(spark, d)
    labels = common.table(spark, d, "labels").where(common.fold("doc_id", 3) != 1).select("doc_id", "toxic")
    scores = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scores.withColumn("held_out", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)))


@query
def op4_near_duplicates(spark, d):
    return neardup.near_duplicates(documents(spark, d))


ORACLE["op4_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
          FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (nx + ny - c)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept
FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""


@query
def op5_substring_dedup(spark, d):
    return substrings.remove_repeats(documents(spark, d)).drop("spans")


def vocabulary(name="word_bpe_49k.json"):
    """The content of a public tokenizer's file, read on the driver."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op8_fingerprints(spark, d):
    return fingerprints.fingerprints(documents(spark, d))


@query
def op9_packing(spark, d):
    return packing.pack_documents(documents(spark, d), vocabulary())


@query
def op7_secret_scan(spark, d):
    return secrets.scan_secrets(documents(spark, d))


def _secret_sql() -> str:
    """The same rules for DuckDB: places from list sums, the interval join as plain existence tests."""
    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(s[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'm': m[i]}})) AS p
            FROM (SELECT doc_id, regexp_extract_all(text, {literal(pattern)}) AS m, regexp_split_to_array(text, {literal(pattern)}) AS s
                  FROM docs WHERE regexp_matches(text, {literal(pattern)}))""" for k, (_, _, pattern, _) in enumerate(secrets.KINDS))
    must = " ".join(f"WHEN {k} THEN regexp_matches(p.m, {literal(must)})" for k, (_, _, _, must) in enumerate(secrets.KINDS) if must)
    roles = " ".join(f"WHEN {k} THEN '{role}'" for k, (_, role, _, _) in enumerate(secrets.KINDS))
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _, _, _) in enumerate(secrets.KINDS))
    apart = "greatest(a.start, b.start) - least(a.stop, b.stop)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
parts AS (SELECT doc_id, kind, CASE kind {roles} END AS role, CAST(p.start AS BIGINT) AS start, CAST(p.start + length(p.m) AS BIGINT) AS stop
          FROM found WHERE CASE kind {must} ELSE true END),
spans AS (SELECT * FROM parts a WHERE kind < {secrets.BASE} OR (
  EXISTS (SELECT 1 FROM parts b WHERE a.doc_id = b.doc_id AND (a.role = 'secret') <> (b.role = 'secret') AND {apart} <= {secrets.REACH})
  AND NOT EXISTS (SELECT 1 FROM parts b WHERE a.doc_id = b.doc_id AND b.kind < {secrets.BASE} AND {apart} < 0))),
told AS (SELECT *, CASE kind {names} END || ':' || start || ':' || stop AS said FROM spans)
SELECT d.doc_id, count(t.kind) FILTER (t.kind = 0) AS n_assign, count(t.kind) FILTER (t.kind = 1) AS n_access, count(t.kind) FILTER (t.kind = 2) AS n_hex,
       sha256(coalesce(string_agg(t.said, ',' ORDER BY t.start, t.kind) FILTER (t.kind < {secrets.BASE}), '')) AS base_sha256,
       coalesce(string_agg(t.said, ',' ORDER BY t.start, t.kind), '') AS spans
FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id GROUP BY d.doc_id
"""


ORACLE["op7_secret_scan"] = _secret_sql()


@query
def op10_lm_scoring(spark, d):
    docs = documents(spark, d)
    scores = kneser_ney.score(docs, kneser_ney.train(docs.where(common.fold("doc_id", 10) != 0)))
    return scores.withColumn("held_out", F.coalesce(common.fold("doc_id", 10) == 0, F.lit(False)))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults of the registered query, in ``copies``; a dropped one only makes its conversation known."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.coalesce("text", blank)
    gone = fault == 0
    return turns.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, None).when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(gone, None).when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


@query
def op12_conversation_repair(spark, d):
    repaired = conversations.repair(damaged(common.table(spark, d, "conversations")))
    told = conversations.transcripts(repaired).withColumnRenamed("conv_id", "c")
    return repaired.conversations.join(told, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def _repair_sql() -> str:
    """The same repair as a recursion over the turns: per role state the least text of cost and audit."""
    def least(*options: str) -> str:
        return f"least({', '.join(options)})"

    def step(state: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{letter}'"

    def inserted(source: str) -> str:
        once = f"SELECT *, {least('u', step('e', '5', 'I'), step('s', '5', 'I'), step('a', '5', 'I'))} AS u1, {least('a', step('u', '5', 'I'))} AS a1 FROM {source}"
        return (f"SELECT * REPLACE ({least('u1', step('a1', '5', 'I'))} AS u, {least('a1', step('u1', '5', 'I'))} AS a) FROM ({once})")

    extra = "(5 * CAST(fault = 3 AS INT))"
    stay = "fault IN (0, 3)"
    to_user = [f"CASE WHEN {stay} THEN {step(x, extra + ' + CASE WHEN i0 = ' + chr(39) + 'u' + chr(39) + ' THEN 0 ELSE 1 END', '#')} END" for x in "esa"]
    to_user = [x.replace("'#'", "CASE WHEN i0 = 'u' THEN 'K' ELSE 'R' END") for x in to_user]
    to_ass = f"CASE WHEN {stay} THEN {step('u', extra + ' + CASE WHEN i0 = ' + chr(39) + 'a' + chr(39) + ' THEN 0 ELSE 1 END', '#')} END".replace(
        "'#'", "CASE WHEN i0 = 'a' THEN 'K' ELSE 'R' END")
    to_system = f"CASE WHEN {stay} AND i0 = 's' THEN {step('e', extra, 'K')} END"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * length(k)),
      lambda j: CAST((ascii(k[CAST(j // 8 + 1 AS BIGINT)]) >> CAST(j % 8 AS INTEGER)) & 1 AS BIGINT))),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 20 AS f FROM src),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE f <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, role[1] AS i0,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
judged AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
    WHEN bare[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(i0) OVER (PARTITION BY conv_id ORDER BY n) || i0 AS pair FROM numbered),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, j.n,
    {step('e', '2', 'D')}, {least(step('s', '2', 'D'), to_system)}, {least(step('u', '2', 'D'), *to_user)}, {least(step('a', '2', 'D'), to_ass)}
  FROM ({inserted('path')}) p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.n = p.n + 1),
last AS (SELECT * FROM ({inserted('path')}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
best AS (SELECT conv_id, least(e, a) AS w FROM last),
letters AS (SELECT conv_id, p, w[10:][p] AS letter, CAST(list_sum(list_transform(string_split(w[10:][1:p], ''), lambda x: CAST(x <> 'I' AS INT))) AS BIGINT) AS n
  FROM (SELECT conv_id, w, unnest(range(1, length(w) - 8)) AS p FROM best)),
stays AS (SELECT l.*, CASE WHEN letter = 'I' THEN '' ELSE j.text END AS text, j.role AS old,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS k, first_value(CAST(letter = 'K' AND j.i0 = 's' AS INT)) OVER (PARTITION BY l.conv_id ORDER BY p) AS sys
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.n = l.n WHERE letter <> 'D'),
text AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN old WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t
  FROM stays GROUP BY conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(w[1:9] AS BIGINT) AS cost, w[10:] AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN text t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE["op12_conversation_repair"] = _repair_sql()


@query
def op13_vector_codes(spark, d):
    compressed = vector_codes.compress(common.table(spark, d, "embeddings"))
    return vector_codes.with_label_errors(compressed.codes).select(
        "vec_id", "code", "error", "label_error", F.lit(compressed.digest()).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The rounds one after another, every part compared with every entry."""
    rounds, near = [], """SELECT v.id, v.p, v.x, arg_min(b.k, {'d': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x), 'k': b.k}) AS k,
      min(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x)) AS d
    FROM parts v JOIN book%d b ON v.p = b.p GROUP BY v.id, v.p, v.x"""
    for r in range(vector_codes.ROUNDS):
        rounds.append(f"""near{r} AS MATERIALIZED ({near % r}),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT p, k, list(floor(s / n) ORDER BY j) AS x FROM (SELECT p, k, j, sum(v) AS s, count(*) AS n FROM (
      SELECT p, k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM near{r}) GROUP BY p, k, j) GROUP BY p, k) m ON m.p = b.p AND m.k = b.k)""")
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
book0 AS (SELECT p, id - 1 AS k, x FROM parts WHERE id <= {vector_codes.ENTRIES}),
{",".join(rounds)},
near AS MATERIALIZED ({near % last}),
coded AS (SELECT id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near GROUP BY id),
digest AS (SELECT sha256(string_agg(t, ',' ORDER BY p, k)) AS h FROM (
    SELECT p, k, array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS t FROM book{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (id), digest
"""


ORACLE["op13_vector_codes"] = _codes_sql()


@query
def op11_html_text(spark, d):
    return html_text.extract(common.table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))
