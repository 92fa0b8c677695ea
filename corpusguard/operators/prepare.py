"""Filters and projections on files and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.rules import ALLOWED_EXTENSIONS

DEFAULT_PASTE_PATH = "pasted-file.js"


def drop_blank(corpus: DataFrame) -> DataFrame:
    """Keep records with a usable path and a content, which may be empty."""
    return corpus.where(F.col("file").isNotNull() & F.col("content").isNotNull() & T.not_blank(F.col("file")))


def keep_extensions(corpus: DataFrame, extensions=ALLOWED_EXTENSIONS) -> DataFrame:
    return corpus.where(T.has_allowed_extension(F.col("file"), extensions))


def drop_ignored_paths(corpus: DataFrame) -> DataFrame:
    return corpus.where(~T.in_ignored_directory(F.col("file")))


def with_file_type(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("file_type", T.file_type(F.col("file")))


def analyzable(corpus: DataFrame, extensions=ALLOWED_EXTENSIONS) -> DataFrame:
    """The files the analysis covers. Every test but the null check on content is on the path alone."""
    return with_file_type(drop_ignored_paths(keep_extensions(drop_blank(corpus), extensions)))


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; a trailing empty line is kept."""
    keep = [c for c in files.columns if c != "content"]
    return (files.select(*keep, F.posexplode_outer(T.split_lines(F.col("content"))).alias("_pos", "line"))
            .select(*keep, (F.col("_pos") + 1).alias("line_no"), "line"))


def drop_suppressed(lines_df: DataFrame) -> DataFrame:
    return lines_df.where(~T.is_suppressed(F.col("line")))


def drop_comments(lines_df: DataFrame) -> DataFrame:
    return lines_df.where(~T.is_comment(F.col("line")))


def with_snippet(lines_df: DataFrame) -> DataFrame:
    return lines_df.withColumn("code", T.snippet(F.col("line")))


def with_loc(files: DataFrame) -> DataFrame:
    """Number of non-blank lines, counted in one pass over the text."""
    # A line is non-blank when its first non-blank character exists; matching from there to
    # the line end makes each match exactly one line.
    return files.withColumn("loc", F.regexp_count(
        F.col("content"), F.lit(r"[^\t-\r\p{Z}\x{FEFF}][^\n]*")).cast("int"))


def with_context(files: DataFrame) -> DataFrame:
    """One row per line with the two lines before and after it."""
    keep = [c for c in files.columns if c != "content"]
    arrays = files.select(*keep, T.split_lines(F.col("content")).alias("_lines"))
    return (arrays.select(*keep, "_lines", F.posexplode_outer("_lines").alias("_pos", "line"))
            .select(*keep, (F.col("_pos") + 1).alias("line_no"), "line",
                    T.context_window(F.col("_lines"), F.col("_pos")).alias("context")))
