"""Orderings and caps. Each rank filter is trimmed per task before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOTSPOTS = 5
PAYLOAD_MODULES, PAYLOAD_FILES, PAYLOAD_FINDINGS, PAYLOAD_LIST = 8, 25, 8, 5
LISTING = 80


def top_per(df: DataFrame, group: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def hotspots(file_risk: DataFrame, limit: int = HOTSPOTS) -> DataFrame:
    """Riskiest files per repository; ties by place in the input."""
    return top_per(file_risk, ["repo"], [F.col("risk_score").desc(), F.col("first_seq"), F.col("file")], limit)


def modules_in_order(modules: DataFrame) -> DataFrame:
    """Position of each module in its repository; there are at most as many as there are roles."""
    window = Window.partitionBy("repo").orderBy(F.col("risk_score").desc(), F.col("finding_count").desc(), "first_seq")
    return modules.withColumn("rank", F.row_number().over(window))


def first_files(files: DataFrame, limit: int = PAYLOAD_FILES) -> DataFrame:
    """First files per repository in input order."""
    return top_per(files, ["repo"], [F.col("seq"), F.col("file")], limit)


def first_findings(findings: DataFrame, limit: int = PAYLOAD_FINDINGS) -> DataFrame:
    return top_per(findings, ["repo", "file"], [F.col("seq"), F.col("line"), F.col("rule_ord")], limit)


def listing(inventory: DataFrame, limit: int = LISTING) -> DataFrame:
    """First paths of each repository's inventory."""
    return top_per(inventory, ["repo"], [F.col("seq"), F.col("file")], limit)


def selected_first(files: DataFrame, path: str) -> DataFrame:
    """Sort order with one file in front, the rest unchanged."""
    return files.orderBy((F.col("file") != path), "repo", "seq")
