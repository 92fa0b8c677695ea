"""Quality of the findings against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(items: DataFrame, alerts: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row per labeled item: ``alert`` and ``vulnerable``.

    ``alerts`` may list an item often; it is reduced to distinct keys first.
    """
    flagged = alerts.select(key).distinct().withColumn("alert", F.lit(True))
    return (items.join(truth.select(key, "vulnerable"), key).join(flagged, key, "left")
            .withColumn("alert", F.coalesce("alert", F.lit(False))))


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 6)


def scores(outcome: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1."""
    hit, miss, false = (F.count_if(F.col("alert") & F.col("vulnerable")), F.count_if(~F.col("alert") & F.col("vulnerable")),
                        F.count_if(F.col("alert") & ~F.col("vulnerable")))
    counted = (outcome.groupBy(*by) if by else outcome.groupBy()).agg(
        hit.alias("true_alerts"), miss.alias("missed"), false.alias("false_alerts"))
    t, m, f = F.col("true_alerts"), F.col("missed"), F.col("false_alerts")
    return (counted.withColumn("precision", _ratio(t, t + f)).withColumn("recall", _ratio(t, t + m))
            .withColumn("f1", _ratio(2 * t, 2 * t + f + m)))


def false_alert_density(outcome: DataFrame) -> DataFrame:
    """False alerts per 1,000 lines; ``outcome`` carries loc."""
    return outcome.groupBy().agg(
        F.count_if(F.col("alert") & ~F.col("vulnerable")).alias("false_alerts"), F.sum("loc").cast("bigint").alias("lines"),
    ).withColumn("per_thousand_lines", _ratio(F.col("false_alerts") * 1000, F.col("lines")))


def detection_rate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Files, files with a finding, and rate by language, by rule title and overall."""
    per_language = files.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))
    overall = per_language.agg(F.sum("files").alias("files"))
    found = (findings.select("repo", "file", "file_type", "title").distinct()
             .groupingSets([["file_type", "title"], ["file_type"], ["title"], []], "file_type", "title")
             .agg(F.count_distinct("repo", "file").alias("files_hit")))
    base = per_language.unionByName(overall.select(F.lit(None).cast("string").alias("file_type"), "files"))
    return (found.join(base, found["file_type"].eqNullSafe(base["file_type"]))
            .select(found["file_type"], "title", "files", "files_hit", _ratio(F.col("files_hit"), F.col("files")).alias("rate")))
