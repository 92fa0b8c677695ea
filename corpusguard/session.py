"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "corpusguard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are planned for; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a skewed join even where the next step could have reused its partitioning
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # checkpoints of finished loops are removed with their DataFrames
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, named by spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="corpusguard-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str = "table", freed: bool = False) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    For results that several branches of a plan read: each branch then prunes the
    columns of a table instead of repeating the scan of the corpus. ``freed``: the
    shuffle files of the write go when it ends, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    if freed:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialized`` wrote, once nothing that still has to run reads them."""
    for table in tables:
        path = table.__dict__.pop("_scratch", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` once to shared storage, bucketed by ``keys``, and read it back.

    For a large side that a loop joins again and again on the same keys: only the
    other side is shuffled from then on. One task writes each bucket, so there is
    one file per bucket.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "buckets")
    name = "buckets_" + path.rsplit("-", 1)[1]
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(name))
    return spark.table(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage on shared storage, so that a lost executor costs no replay."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
