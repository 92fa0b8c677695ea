"""Sinks for the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusguard.operators import aggregate as A


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "repo",
                mode: str = "errorifexists") -> None:
    """Write one result, in a folder per repository.

    The rebalance hint gathers a repository's rows into few files and still
    splits a repository that is far larger than the others.
    """
    writer = (df.hint("rebalance", partition_by) if partition_by else df).write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def write_results(result, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> list[str]:
    """Findings, metadata, summaries, hotspots, the files of each module and the compact payloads under ``path``."""
    from corpusguard.plans.analysis import compact_payloads
    root = path.rstrip("/")
    tables = {"findings": result.findings, "metadata": result.metadata, "modules": result.modules, "repos": result.repos,
              "hotspots": result.hotspots, "module_files": A.module_files(result.profiles), "payloads": compact_payloads(result)}
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", fmt, None if name in ("repos", "payloads") else "repo", mode)
    return [f"{root}/{name}" for name in tables]
