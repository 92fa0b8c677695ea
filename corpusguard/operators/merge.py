"""Upserts of results: the last value wins, the first position stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ["version", "seq"]
POSITION = "struct<version:bigint,seq:bigint>"


def versioned(df: DataFrame, version: int) -> DataFrame:
    return df.withColumn("version", F.lit(version).cast("bigint"))


def upsert(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of several versions to one row per key.

    ``position`` is the place of the first appearance, ``version`` that of the
    values; rows that are the result of earlier upserts bring their position along.
    The aggregate combines before its shuffle.
    """
    values = [c for c in rows.columns if c not in key and c != "position"]
    latest = F.max_by(F.struct(*values), F.struct(*ORDER))
    own = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ORDER])
    first = F.coalesce("position", own) if "position" in rows.columns else own
    return rows.groupBy(*key).agg(latest.alias("_v"), F.min(first).alias("position")).select(*key, "_v.*", "position")


def merge_metadata(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Both sides carry ``version``."""
    return upsert(previous.unionByName(following), ["repo", "file"])


def merge_findings(previous: DataFrame, following: DataFrame, replace: bool = False,
                   rescanned: DataFrame | None = None) -> DataFrame:
    """Upsert by finding id. Ids that vanished stay, unless ``replace`` is set.

    With ``replace`` the files listed in ``rescanned`` (repo, file) keep only what
    the following run found.
    """
    merged = upsert(previous.unionByName(following), ["repo", "id"])
    if not replace:
        return merged
    files = (rescanned if rescanned is not None else following).select("repo", "file").distinct()
    current = following.select("repo", "id").distinct()
    untouched = merged.join(files, ["repo", "file"], "left_anti")
    return untouched.unionByName(merged.join(files, ["repo", "file"], "left_semi")
                                 .join(current, ["repo", "id"], "left_semi").select(*untouched.columns))


def known_counts(known: DataFrame | None, previous: DataFrame | None, merged_files: DataFrame) -> DataFrame:
    """File count per repository: the known count, else the previous one, else 1.

    ``known`` and ``previous`` are (repo, file_count); a count of zero does not count.
    """
    out = merged_files.select("repo").distinct()
    picks = []
    for name, side in (("_known", known), ("_previous", previous)):
        if side is not None:
            out = out.join(side.select("repo", F.col("file_count").alias(name)), "repo", "left")
            picks.append(F.nullif(F.col(name), F.lit(0)))
    return out.select("repo", F.coalesce(*picks, F.lit(1)).cast("bigint").alias("file_count"))
