"""Compact payloads, cache keys and prompt texts. All lists in a payload are capped, so a row stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.operators import rank
from corpusguard.operators.aggregate import SEVERITIES
from corpusguard.session import materialized

# ---------------------------------------------------------------------------
# Prompt texts
# ---------------------------------------------------------------------------
REPO_PROMPT = """You are a senior application security reviewer.

Use only this compact static-analysis payload. It includes security findings and AST-derived file/module metadata for files the user has scanned so far.

Mode: {mode}
Source: {url}

Compact analysis JSON:
{payload}

Return concise markdown with:
1. Repository or file purpose in security terms
2. Highest-risk findings and why they matter
3. Architectural hotspots from module metadata
4. Practical next review steps

Do not ask for full source. Do not invent files that are not in the payload."""
MODE_TEXT = {"dev": "single pasted file / dev mode", "repo": "repository scan"}

FINDING_PROMPT = """You are a security analyst helping developers understand security findings.

Finding Type: {title}
File: {file}
Line: {line}
Code: {code}

Context snippet:
{snippet}

Explain the security issue with:
1. **Why risky** - What makes this pattern dangerous?
2. **Attack scenario** - How could an attacker exploit this?
3. **Better fix** - Show corrected code example
4. **Beginner explanation** - Simple terms for junior developers

Return as clean markdown with short sections. Be actionable and clear."""
# --------------------------- end of fixed values ---------------------------


def fill(template: str, **values: Column) -> Column:
    """A text column from a template with named places."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def prompt_for_repo(payloads: DataFrame) -> DataFrame:
    """Needs url, mode and payload."""
    mode = F.when(F.col("mode") == "dev", F.lit(MODE_TEXT["dev"])).otherwise(F.lit(MODE_TEXT["repo"]))
    return payloads.withColumn("prompt", fill(REPO_PROMPT, mode=mode, url=F.col("url"), payload=F.col("payload")))


def prompt_for_finding(findings: DataFrame) -> DataFrame:
    """Needs title, file, line, code and context."""
    return findings.withColumn("prompt", fill(
        FINDING_PROMPT, title=F.col("title"), file=F.col("file"), line=F.col("line").cast("string"),
        code=F.col("code"), snippet=F.col("context")))


def _list(df: DataFrame, key: list[str], order: Column, item: Column, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("v"))))
    return df.groupBy(*key).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def payload_files(metadata: DataFrame, findings: DataFrame) -> DataFrame:
    """The first files of each repository with their capped details.

    Findings are cut down to the chosen files by a join on at most PAYLOAD_FILES
    rows per repository, then capped per file.
    """
    short = rank.PAYLOAD_LIST
    chosen = rank.first_files(metadata.select(
        "repo", "file", "seq", "module_purpose", "metrics", F.slice("entry_points", 1, short).alias("entry_points"),
        F.slice(F.transform("framework_hints", lambda h: h["framework"]), 1, short).alias("frameworks"),
        F.slice("dependencies", 1, short).alias("dependencies")))
    of_files = findings.join(chosen.select("repo", "file"), ["repo", "file"], "left_semi")
    risk = of_files.groupBy("repo", "file").agg(F.sum("weight").cast("bigint").alias("risk"))
    top = _list(rank.first_findings(of_files, rank.PAYLOAD_FINDINGS), ["repo", "file"], F.col("rank"),
                F.struct("title", "severity", F.col("line"), "code"), "findings")
    kind = top.schema["findings"].dataType
    return (chosen.join(risk, ["repo", "file"], "left").join(top, ["repo", "file"], "left").fillna(0, ["risk"])
            .withColumn("findings", F.coalesce("findings", F.array().cast(kind))))


def payload_modules(ordered_modules: DataFrame) -> DataFrame:
    short = rank.PAYLOAD_LIST
    return (ordered_modules.where(F.col("rank") <= rank.PAYLOAD_MODULES)
            .withColumn("dependencies", F.slice("dependencies", 1, short))
            .withColumn("frameworks", F.slice("frameworks", 1, short)))


def compact_payload(repos: DataFrame, hotspots: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """One JSON text per repository, no source text in it beyond the finding snippets."""
    metrics = F.struct(
        F.col("metrics.lines_of_code").alias("linesOfCode"), F.col("metrics.function_count").alias("functionCount"),
        F.col("metrics.class_count").alias("classCount"), F.col("metrics.import_count").alias("importCount"),
        F.col("metrics.export_count").alias("exportCount"))
    hot = _list(hotspots, ["repo"], F.col("rank"),
                F.struct("file", "count", F.col("risk_score").alias("riskScore")), "hotspots")
    mods = _list(modules, ["repo"], F.col("rank"), F.struct(
        F.col("module_purpose").alias("purpose"), F.col("file_count").alias("fileCount"),
        F.col("finding_count").alias("findingCount"), F.col("top_findings").alias("topFindings"),
        "dependencies", "frameworks", F.col("risk_score").alias("riskScore")), "modules")
    items = _list(files, ["repo"], F.col("rank"), F.struct(
        F.col("file").alias("path"), F.col("module_purpose").alias("purpose"), "risk", metrics.alias("metrics"),
        F.col("entry_points").alias("entryPoints"), "frameworks", "dependencies", "findings"), "files")
    out = repos
    for name, part in (("hotspots", hot), ("modules", mods), ("files", items)):
        out = out.join(part, "repo", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    head = F.struct(
        F.col("file_count").alias("fileCount"), F.col("scanned_file_count").alias("scannedFileCount"),
        F.col("finding_count").alias("findingCount"),
        F.struct(*[F.col(s.lower()).alias(s) for s in SEVERITIES]).alias("severityCounts"),
        F.col("risk_score").alias("riskScore"), "frameworks", "hotspots")
    return out.select("repo", F.to_json(F.struct(head.alias("repo"), "modules", "files")).alias("payload"))


def cache_text(payloads: DataFrame) -> Column:
    """What the cache key is taken over: source, mode and payload."""
    url = F.to_json(F.struct(F.col("url").alias("repoUrl"), (F.col("mode") == "dev").alias("devMode")))
    return F.concat(F.substring(url, F.lit(1), F.length(url) - 1), F.lit(',"compactPayload":'), F.col("payload"), F.lit("}"))


def with_key(df: DataFrame, text: Column, name: str = "key", strong: bool = True) -> DataFrame:
    """A digest, or with ``strong`` off the short compatible key, whose 32 bits collide in large caches."""
    return df.withColumn(name, T.digest_key(text) if strong else T.content_key(text))


def cache_misses(payloads: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return payloads.join(cache.select(key).distinct(), key, "left_anti")


#: Bits of one part of a key sketch, bits kept per cached key, and the bits that each key sets.
PART_BITS, BITS_PER_KEY, PROBES = 1 << 15, 12, 3
#: A sketch of more bytes is not sent to all tasks.
SKETCH_BYTES = 64 << 20


def _probes(key: str, parts: int) -> list[Column]:
    """Where the bits of a key stand, as (part, bit): all in one part, so that one row of the sketch answers for a key."""
    h = F.xxhash64(key, F.lit(0))
    part = F.pmod(h, F.lit(parts))
    return [F.struct(part.cast("int").alias("part"), F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(PART_BITS)).cast("int").alias("bit"))
            for i in range(PROBES)]


def key_sketch(cache: DataFrame, key: str = "key") -> DataFrame | None:
    """A Bloom filter of the cached keys as rows (part, bits), or None if it would exceed SKETCH_BYTES.

    The size follows the number of keys: 12 bits each leave about one miss in two hundred undecided.
    """
    keys = cache.select(key).where(F.col(key).isNotNull())
    parts = max(1, -(-keys.count() * BITS_PER_KEY // PART_BITS))
    if parts * PART_BITS // 8 > SKETCH_BYTES:
        return None
    set_bits = keys.select(F.explode(F.array(*_probes(key, parts))).alias("p")).select("p.*")
    bits = F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits")
    return set_bits.groupBy("part").agg(bits).select("part", "bits", F.lit(parts).alias("parts"))


def _possible(payloads: DataFrame, sketch: DataFrame, key: str) -> DataFrame:
    """``payloads`` with ``_maybe``: false only if the key is certainly not cached."""
    first = sketch.select("parts").head()
    if first is None:
        return payloads.withColumn("_maybe", F.lit(False))
    probes = _probes(key, first["parts"])
    found = payloads.withColumn("_part", probes[0]["part"]).join(
        F.broadcast(sketch.select(F.col("part").alias("_part"), "bits")), "_part", "left")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(bit, F.lit(8)))

    held = F.lit(True)
    for p in probes:
        held = held & (is_set(p["bit"]) == 1)
    return found.withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("_part", "bits")


def reuse(payloads: DataFrame, cache: DataFrame, key: str = "key", result: str = "result", order: str = "stored_at") -> DataFrame:
    """All of ``payloads`` with ``hit`` and, for hits, the stored ``result``; misses, with a null result, are what has to be made.

    Of several results of one key the one stored last counts (``order``, ties by the greater result). Keys that a sketch of
    the cache rules out stay where they are; only the others are joined. A cache whose sketch would be too large to send is
    joined with all payloads, with the same rows. Null keys never hit.
    """
    stored = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(result, F.struct(order, result)).alias(result))
    stored = materialized(stored.withColumn("hit", F.lit(True)), "cache")
    sketch = key_sketch(stored, key)
    if sketch is None:
        return payloads.join(stored, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    told = materialized(_possible(payloads, materialized(sketch, "sketch"), key), "payloads")
    maybe = told.where("_maybe").drop("_maybe").join(stored, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    kind = stored.schema[result].dataType
    return maybe.unionByName(told.where("NOT _maybe").drop("_maybe").withColumn(result, F.lit(None).cast(kind)).withColumn("hit", F.lit(False)))


def listing(metadata: DataFrame) -> DataFrame:
    """Display strings of the detail variant."""
    text = lambda c: c.cast("string")
    return metadata.select(
        "repo", "file", "seq",
        F.transform("functions", lambda f: F.concat(
            f["name"], F.lit("() · line "), text(f["line"]), F.when(f["is_async"], F.lit(" · async")).otherwise(F.lit("")))).alias("functions"),
        F.transform("exports", lambda e: F.concat(e["name"], F.lit(" · "), e["type"], F.lit(" · line "), text(e["line"]))).alias("exports"),
        F.transform("classes", lambda c: F.concat(
            c["name"], F.coalesce(F.concat(F.lit(" extends "), c["extends"]), F.lit("")), F.lit(" · "),
            text(F.size(c["methods"])), F.lit(" methods"))).alias("classes"),
        F.transform("framework_hints", lambda h: F.concat(
            h["framework"], F.lit(" · "), text(F.floor(h["confidence"] * 100 + 0.5)), F.lit("% confidence"))).alias("frameworks"),
        F.transform("imports", lambda i: F.concat(
            i["source"], F.lit(" → "),
            F.when(F.size(i["bindings"]) == 0, F.lit("side effect")).otherwise(F.array_join(
                F.transform(i["bindings"], lambda b: F.concat(b["imported"], F.lit(" as "), b["local"])), ", ")))).alias("imports"))
