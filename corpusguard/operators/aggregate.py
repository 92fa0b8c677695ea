"""Roll-ups of findings and files. Grouping columns always lead with ``repo``.

Every aggregate combines on the map side, so one repository holding most of the
rows costs one row per task in the shuffle. Lists are capped by rank, which is
trimmed before the shuffle; uncapped lists are returned as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.functions.skew import first_distinct
from corpusguard.operators import structure as S
from corpusguard.rules import SEVERITY_WEIGHTS

SEVERITIES = tuple(SEVERITY_WEIGHTS)
MODULE_TITLES, MODULE_DEPS, MODULE_FRAMEWORKS = 5, 8, 8
REPO_FRAMEWORKS, REPO_DEPS = 12, 20
# Titles and captions of the overview
OPENED, RISK, FINDINGS, MODULES = "Files opened", "Risk score", "Findings", "Modules"
DISCOVERED, CRITICAL, HIGH = " discovered", " critical, ", " high"
NO_FRAMEWORK_TEXT = "No framework signal yet"
WEIGHTS_TEXT = "Critical 10, high 5, medium 2, low 1"


def severity_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All four severities as columns, zeros included."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return findings.groupBy(*(by or ["repo"])).agg(*counts)


def risk(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Finding count and risk; without ``by`` a single row, 0 when empty."""
    total = [F.count(F.lit(1)).alias("finding_count"), F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("risk_score")]
    return findings.groupBy(*by).agg(*total) if by else findings.agg(*total)


def file_risk(findings: DataFrame) -> DataFrame:
    """Files with findings: count, risk and their place in the input."""
    return findings.groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("count"), F.sum("weight").cast("bigint").alias("risk_score"), F.min("seq").alias("first_seq"))


def files_with_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    """All files with their findings as an ordered array, empty for none."""
    item = F.struct("line", "rule_ord", "title", "severity", "code")
    per_file = findings.groupBy("repo", "file").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    return (files.join(per_file, ["repo", "file"], "left")
            .withColumn("findings", F.coalesce("findings", F.array().cast(per_file.schema["findings"].dataType))))


def module_counts(profiles: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per (repo, purpose) without lists. Findings are summed per file before they meet the files."""
    of_file = profiles.select(*S.FILE, "module_purpose")
    return (of_file.join(file_risk(findings), ["repo", "file"], "left").groupBy("repo", "module_purpose").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("finding_count"),
        F.coalesce(F.sum("risk_score"), F.lit(0)).alias("risk_score"), F.min("seq").alias("first_seq")))


def modules(profiles: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """One row per (repo, purpose) with its lists."""
    key = ["repo", "module_purpose"]
    of_file = profiles.select(*S.FILE, "module_purpose")
    counted = module_counts(profiles, findings)
    titles = findings.groupBy("repo", "file", "title").agg(F.min(F.struct("line", "rule_ord")).alias("_o"))
    titles = of_file.join(titles, ["repo", "file"]).select(*key, "title", "seq", "_o")
    deps = of_file.join(S.dependencies(events), S.FILE).select(*key, "dependency", "seq", "place")
    frameworks = hint_order(events).join(of_file, S.FILE).select(*key, "framework", "seq", "ord")
    lists = {
        "top_findings": first_distinct(titles, key, "title", ["seq", "_o"], MODULE_TITLES, "top_findings"),
        "dependencies": first_distinct(deps, key, "dependency", ["seq", "place"], MODULE_DEPS, "dependencies"),
        "frameworks": first_distinct(frameworks, key, "framework", ["seq", "ord"], MODULE_FRAMEWORKS, "frameworks"),
    }
    return _with_lists(counted, key, lists)


def module_files(profiles: DataFrame) -> DataFrame:
    """The files of each module, as rows: a module can span most of a corpus."""
    return profiles.select("repo", "module_purpose", "seq", "file")


def hint_order(events: DataFrame) -> DataFrame:
    return (S.framework_signals(events).groupBy(*S.FILE, "framework").agg(F.min(F.struct("place", "pos")).alias("ord")))


def _with_lists(base: DataFrame, key: list[str], lists: dict[str, DataFrame]) -> DataFrame:
    for name, part in lists.items():
        base = base.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return base


def repo_totals(input_counts: DataFrame, files: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """One row per repository; ``input_counts`` is (repo, file_count) over all inputs, rejected ones included, ``files`` has a row per analyzed file."""
    key = ["repo"]
    scanned = files.groupBy("repo").agg(F.count(F.lit(1)).alias("scanned_file_count"))
    counted = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("finding_count"), F.sum("weight").cast("bigint").alias("risk_score"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    totals = input_counts.join(scanned, key, "left").join(counted, key, "left").fillna(0)
    deps = S.dependencies(events)
    frameworks = hint_order(events)
    return _with_lists(totals, key, {
        "frameworks": first_distinct(frameworks, key, "framework", ["seq", "ord"], REPO_FRAMEWORKS, "frameworks"),
        "dependencies": first_distinct(deps, key, "dependency", ["seq", "place"], REPO_DEPS, "dependencies"),
    })


def input_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("repo").agg(F.count(F.lit(1)).alias("file_count"))


def overview(repos: DataFrame, module_counts: DataFrame) -> DataFrame:
    """Four headline metrics per repository with their captions."""
    r = repos.join(module_counts, "repo", "left").fillna(0, ["module_count"])
    top = F.array_join(F.slice("frameworks", 1, 3), ", ")
    cards = F.array(
        _card(1, OPENED, "scanned_file_count", F.concat(F.col("file_count").cast("string"), F.lit(DISCOVERED))),
        _card(2, RISK, "risk_score", F.lit(WEIGHTS_TEXT)),
        _card(3, FINDINGS, "finding_count", F.concat(F.col("critical").cast("string"), F.lit(CRITICAL),
                                                     F.col("high").cast("string"), F.lit(HIGH))),
        _card(4, MODULES, "module_count", F.when(top == "", F.lit(NO_FRAMEWORK_TEXT)).otherwise(top)))
    return r.select("repo", F.inline(cards))


def _card(position: int, label: str, value: str, caption):
    return F.struct(F.lit(position).alias("pos"), F.lit(label).alias("label"),
                    F.col(value).cast("bigint").alias("value"), caption.alias("subtext"))
