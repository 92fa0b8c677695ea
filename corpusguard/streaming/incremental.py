"""Incremental runs: the same scan on a stream, merged into an append-only log of versions.

A batch writes one folder per table, run and batch, and writes it again in full when
it is retried, so a lost executor or driver changes nothing. Reading the log
upserts by key; ``compact`` folds old versions into one folder beside the batches, with
the first positions, and a run that continues a compacted log counts as a later epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from corpusguard.operators import aggregate as A, merge, prepare, roles, structure as S
from corpusguard.plans.findings import build_findings
from corpusguard.rules import RuleSet
from corpusguard.sources.readers import CORPUS_SCHEMA

PROFILE_COLUMNS = [*S.FILE, "file_type", "module_purpose", "confidence", "lines_of_code", "function_count",
                   "class_count", "import_count", "export_count", "frameworks"]


def read_corpus_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return (spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path))


def scan_stream(corpus_stream: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings of each newly arrived file; stateless, append mode."""
    return build_findings(corpus_stream, rules)


def write_findings(corpus_stream: DataFrame, path: str, checkpoint: str, rules: RuleSet | None = None) -> DataStreamWriter:
    return (scan_stream(corpus_stream, rules).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def latest_files(corpus_stream: DataFrame) -> DataFrame:
    """Per file its newest length and first place, as streaming state; for update mode.

    The state holds one small row per file, no contents.
    """
    newest = F.max_by(F.struct(F.length("content").alias("length"), F.sha2("content", 256).alias("digest")), "seq")
    return (prepare.analyzable(corpus_stream).groupBy("repo", "file")
            .agg(newest.alias("_v"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
            .select("repo", "file", "_v.*", "first_seq", "last_seq"))


#: Batches of an epoch have versions from epoch * EPOCH on; a compacted log starts the next epoch.
EPOCH = 1 << 32


def log_batches(corpus_stream: DataFrame, log: str, checkpoint: str, rules: RuleSet | None = None, epoch: int = 0,
                on_batch: Callable[[SparkSession, str], None] | None = None) -> DataStreamWriter:
    """Append the findings and profiles of each batch to ``log``.

    ``epoch`` is one more for each compaction that the log went through, so that new
    batches neither replace its folder nor lose against its versions. ``on_batch``
    is called with (spark, log) once a batch is written, for example to refresh a summary.
    """
    rules = rules or RuleSet()

    def write(batch: DataFrame, batch_id: int) -> None:
        version = epoch * EPOCH + batch_id
        files = prepare.analyzable(batch, rules.extensions)
        parts = {"findings": build_findings(batch, rules),
                 "profiles": roles.profiles(files, S.events(files)).select(*PROFILE_COLUMNS),
                 "inputs": batch.select("repo", "file", "seq")}
        for name, df in parts.items():
            merge.versioned(df, version).write.mode("overwrite").parquet(f"{log}/{name}/batch={version}")
        if on_batch is not None:
            on_batch(batch.sparkSession, log)
    return (corpus_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True))


BASE = "batch=-1"


def read_log(spark: SparkSession, log: str, name: str) -> DataFrame:
    """All versions of a table, ``position`` being the first place of what a compaction folded, else null."""
    rows = spark.read.option("basePath", f"{log}/{name}").option("mergeSchema", "true").parquet(f"{log}/{name}/batch=*").drop("batch")
    return rows if "position" in rows.columns else rows.withColumn("position", F.lit(None).cast(merge.POSITION))


def _merged(spark: SparkSession, log: str, name: str, key: list[str]) -> DataFrame:
    return merge.upsert(read_log(spark, log, name), key)


def merged_findings(spark: SparkSession, log: str) -> DataFrame:
    return _merged(spark, log, "findings", ["repo", "id"])


def merged_profiles(spark: SparkSession, log: str) -> DataFrame:
    return _merged(spark, log, "profiles", ["repo", "file"])


def compact(spark: SparkSession, log: str, name: str, key: list[str], target: str) -> None:
    """Write the current state of one table of the log to ``target``, to be continued by runs of the next epoch.

    It has a folder of its own, which no batch writes, and keeps versions and first positions.
    """
    _merged(spark, log, name, key).write.mode("overwrite").parquet(f"{target}/{name}/{BASE}")


def summary(spark: SparkSession, log: str) -> DataFrame:
    """Repository totals over everything logged so far."""
    findings, profiles = merged_findings(spark, log), merged_profiles(spark, log)
    inputs = read_log(spark, log, "inputs").select("repo", "file").distinct()
    counted = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("finding_count"), F.sum("weight").cast("bigint").alias("risk_score"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in A.SEVERITIES])
    return (A.input_counts(inputs)
            .join(profiles.groupBy("repo").agg(F.count(F.lit(1)).alias("scanned_file_count")), "repo", "left")
            .join(counted, "repo", "left").fillna(0))


def run(writer: DataStreamWriter) -> StreamingQuery:
    """Start, wait for the available data, and raise what failed."""
    query = writer.start()
    query.awaitTermination()
    return query
