"""Secret scan with multipart credential linking, in DataFrame functions only.

Three base kinds are always reported. Weak candidates (account identifiers, mixed
tokens, service addresses) are parts of a credential: one is reported only if a
complementary part lies within the same scope, that is with at most ``reach`` code
points between them. An identifier or an address needs a secret; a secret needs an
identifier or an address. Base spans count as parts too, and a candidate that
overlaps a base span is that span and not reported again.

The parts of all texts go to one row each, with places from running sums of the
pieces between the matches. The interval join of the parts of a document is a sweep
in order of their starts: the largest end so far and the least start to come of
each role decide whether a complement is in reach, so it takes one pass whatever
the number of parts.

Nulls and edges: a null text is empty; a document without spans has counts of 0 and
empty strings. Every row is reported; those with the same id and text, null ids
included, are read once. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.llm import common

#: Kind, role, pattern, and the pattern that a match must contain.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
KINDS = (
    ("assign", "secret", f"(?i){ASSIGN}+)", f"(?i)^{ASSIGN}{{6,}})$"),
    ("access", "identifier", r"AKIA[A-Z0-9]{16,}", ""),
    ("hex", "secret", r"[0-9a-f]{24,}", ""),
    ("identifier", "identifier", r"""(?i)(?:user_?name|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""", ""),
    ("mixed", "secret", r"[A-Za-z0-9+/_-]{20,}", r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"),
    ("address", "address", r"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{3,}""", ""),
)
BASE = 3
REACH = 400
MASK = "[secret]"


def _places(text: Column, pattern: str, must: str) -> Column:
    """Lengths of the pieces before the matches, and of the matches with whether they count, side by side."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                          lambda m: F.struct(F.length(m).alias("len"), m.rlike(must).alias("ok")))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), matches.alias("m")))


def parts(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, h, kind (place in KINDS, -1 for the document itself), start, stop, reported, rows (equal rows of the document).

    One exchange: everything after it works within a document's own rows.
    """
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    own = F.array(F.struct(F.lit(0).alias("gap"), F.struct(F.lit(0).alias("len"), F.lit(False).alias("ok")).alias("m")))
    per_kind = [F.struct(F.lit(-1).alias("kind"), own.alias("places"))] + [
        F.struct(F.lit(k).alias("kind"), _places(text, pattern, must).alias("places")) for k, (_, _, pattern, must) in enumerate(KINDS)]
    rows = (found.select("doc_id", "h", F.explode(F.array(*per_kind)).alias("k"))
            .select("doc_id", "h", "k.kind", F.posexplode("k.places").alias("i", "p"))
            .select("doc_id", "h", "kind", "i", F.col("p.gap").alias("gap"), F.col("p.m.len").alias("len"), F.col("p.m.ok").alias("ok"))
            .where("len IS NOT NULL").repartition("doc_id", "h").groupBy("doc_id", "h", "kind", "i")
            .agg(*[F.first(c).alias(c) for c in ("gap", "len", "ok")], F.count(F.lit(1)).alias("rows")))
    up_to = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(up_to)).where("ok OR kind = -1")
              .select("doc_id", "h", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop", "rows"))
    before = Window.partitionBy("doc_id", "h").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "h").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    kind, start, stop = F.col("kind"), F.col("start"), F.col("stop")

    def within(wanted: Column, distance: int) -> Column:
        """Whether another part that is ``wanted`` is less than ``distance`` away; 0 asks for an overlap."""
        earlier = F.max(F.when(wanted, stop)).over(before) > start - distance
        later = F.min(F.when(wanted, start)).over(after) < stop + distance
        return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))

    roles = {r: kind.isin([k for k, x in enumerate(KINDS) if x[1] == r]) for r in ("identifier", "secret", "address")}
    complement = F.when(roles["secret"], within(roles["identifier"] | roles["address"], reach + 1)).otherwise(
        within(roles["secret"], reach + 1))
    base = kind.between(0, BASE - 1)
    reported = F.when(kind < 0, False).when(base, True).otherwise(complement & ~within(base, 0))
    return placed.select("doc_id", "h", "kind", "start", "stop", reported.alias("reported"), "rows")


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document: doc_id, h (hash of its text), rows, counts per base kind, and its spans as an array (start, kind, stop)."""
    all_parts = parts(docs, reach)
    spans = F.array_sort(F.collect_list(F.when(F.col("reported"), F.struct("start", "kind", "stop"))))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    return all_parts.groupBy("doc_id", "h").agg(F.max("rows").alias("rows"), *counts, spans.alias("spans"))


def described(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of ``docs``."""
    found = secret_spans(docs, reach).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    base = described(F.filter("spans", lambda s: s["kind"] < BASE))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span replaced by MASK and n_chars counted anew; all rows and columns stay."""
    columns, docs = docs.columns, common.renamed(docs, "doc_id", "text", "n_chars")
    reported = parts(docs, reach).where("reported")
    order = Window.partitionBy("doc_id", "h").orderBy("start", "stop")
    reach_so_far = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = (reported.withColumn("far", F.coalesce(reach_so_far, F.lit(-1)))
               .withColumn("island", F.sum((F.col("start") >= F.col("far")).cast("int")).over(order))
               .groupBy("doc_id", "h", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    cuts = islands.withColumn("last", F.coalesce(F.lag("stop").over(Window.partitionBy("doc_id", "h").orderBy("start")), F.lit(0)))
    per_doc = cuts.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "last"))).alias("_cuts"))
    hashed = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = hashed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_h")), "left")
    heads = F.transform("_cuts", lambda c: F.concat(F.substring("text", c["last"].cast("int") + 1, (c["start"] - c["last"]).cast("int")), F.lit(MASK)))
    tail = F.substring("text", F.element_at("_cuts", -1)["stop"].cast("int") + 1, F.length("text"))
    masked = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(heads, ""), tail))
    out = both.withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns).toDF(*columns)
