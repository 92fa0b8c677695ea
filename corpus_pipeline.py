"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents, extra ones included. Nulls, repeated rows and empty tables are
treated as the operators' modules say; rows that share an id are one document, of
which the near-duplicate stage keeps one row, and rows without id are kept by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusguard.llm import common, decontaminate, language, neardup, packing, secrets
from corpusguard.llm.queries import vocabulary
from corpusguard.session import materialized


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near some language's centroid; the others, and those without a letter, go."""
    model = language.fit_languages(docs.where(common.fold("doc_id", 4) != 2))
    rows = common.renamed(docs, "doc_id", "text")
    judged = language.predict_languages(rows, model, keep=tuple(c for c in rows.columns if c != "doc_id"))
    return judged.where("NOT rejected").select(*rows.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id."""
    rows = common.renamed(docs, "doc_id", "text")
    kept = neardup.near_duplicates(rows).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text")
    named = (rows.join(kept, "doc_id", "left_semi").withColumn("place", F.row_number().over(first))
             .where("place = 1").select(*rows.columns))
    return named.unionByName(rows.where("doc_id IS NULL")).toDF(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    rows = common.renamed(docs, "doc_id", "text").withColumn("own", F.xxhash64("text"))
    leaks = decontaminate.find_leaks(docs, common.table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias("leaked"), F.col("h").alias("hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("leaked")) & (F.col("own") == F.col("hash"))
    return rows.join(leaks, same, "left_anti").drop("own").toDF(*docs.columns)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", masked_secrets),
    ("packing", packed),
]
#: Hashing, sketches and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return docs
