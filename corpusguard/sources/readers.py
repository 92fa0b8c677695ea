"""Sources: tables and trees of source files, file inventories, encoded contents, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corpusguard.functions import text as T
from corpusguard.operators.prepare import DEFAULT_PASTE_PATH
from corpusguard.rules import ALLOWED_EXTENSIONS

CORPUS_SCHEMA = Ty.StructType([
    Ty.StructField("repo", Ty.StringType()), Ty.StructField("file", Ty.StringType()),
    Ty.StructField("content", Ty.StringType()), Ty.StructField("seq", Ty.LongType()),
])

# Answers to unusable requests
NO_URL, NO_PATH, BAD_URL = "Missing repository URL", "Missing file path", "Invalid GitHub repository URL"
NO_SOURCE_URL, NO_ANALYSIS = "Missing or invalid repository URL", "Missing compact analysis payload"
NO_EXPLAIN = "Missing explanation payload. Required: title, file, line, code, snippet"
NOT_DECODABLE = "Unable to decode file content"
NO_PASTE = "Paste source code before analyzing."


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A corpus table: repo, file, content, seq. The schema is given, never inferred.

    Contents are read where they lie and never dealt anew; spark.sql.files.maxPartitionBytes
    sets how much of the table a task takes.
    """
    return spark.read.schema(CORPUS_SCHEMA).format(fmt).load(path)


def read_tree(spark: SparkSession, root: str, repo: str, glob: str | None = None, analyzable_only: bool = False) -> DataFrame:
    """Files under ``root`` as a corpus, with paths relative to it.

    With ``analyzable_only`` files with other extensions or in ignored folders are left out while the scan is planned: the
    test is on the listed paths alone, which prunes files before tasks are packed by bytes, so their contents are never read.

    ``seq`` is a hash of the path, the same in every run whatever the splits are;
    pass a corpus table instead where the input order matters.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    prefix = rf"^.*?\Q{root.rstrip('/')}\E/"
    files = reader.load(root)
    if analyzable_only:
        # listed paths are spelled as URLs; neither the extensions nor the folders have signs that look different there
        below = F.regexp_replace("_metadata.file_path", prefix, "")
        files = files.where(T.has_allowed_extension(below, ALLOWED_EXTENSIONS) & ~T.in_ignored_directory(below))
    return files.select(
        F.lit(repo).alias("repo"), F.regexp_replace("path", prefix, "").alias("file"),
        as_text(F.col("content")).alias("content"), F.expr("xxhash64(path) & 9223372036854775807").alias("seq"))


def as_text(binary: Column) -> Column:
    """UTF-8 text with a replacement character for what is not valid."""
    return F.make_valid_utf8(binary.cast("string"))


def inventory(tree: DataFrame) -> DataFrame:
    """Paths of the files of a tree listing."""
    return tree.where((F.col("type") == "blob") & F.col("path").isNotNull())


def decode_content(encoded: DataFrame) -> DataFrame:
    """Base64 contents to text; another encoding or no content becomes an error row."""
    usable = F.col("content").isNotNull() & (F.coalesce("encoding", F.lit("")) == "base64")
    return (encoded.withColumn("error", F.when(~usable, F.lit(NOT_DECODABLE)))
            .withColumn("content", F.when(usable, as_text(F.unbase64("content")))))


def repo_segments(url: Column) -> Column:
    """Path segments of a repository URL; null when the host is another one or the URL is unusable."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.regexp_replace(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"^/", ""), r"\.git\z", "")
    segments = F.split(path, "/")
    return F.when(host.isin(*T.REPO_HOSTS) & (F.size(segments) >= 2), segments)


def with_repo(urls: DataFrame, url: str = "url") -> DataFrame:
    segments = repo_segments(F.col(url))
    return urls.withColumn("owner", segments[0]).withColumn("repo_name", segments[1])


def blank(c: Column) -> Column:
    return c.isNull() | ~T.not_blank(c)


def check_requests(requests: DataFrame, need_path: bool = True) -> DataFrame:
    """Route file or scan requests: ``ok`` and the first reason against."""
    url = F.col("url")
    reason = F.when(blank(url), NO_URL)
    if need_path:
        reason = reason.when(blank(F.col("path")), NO_PATH)
    reason = reason.when(repo_segments(T.full_trim(url)).isNull(), BAD_URL)
    return requests.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def check_insight_requests(requests: DataFrame) -> DataFrame:
    """``analysis`` must be the text of a JSON object or array."""
    body = F.col("analysis")
    kind = F.schema_of_variant(F.try_parse_json(body))
    reason = (F.when(blank(F.col("url")), NO_SOURCE_URL)
              .when(kind.isNull() | ~kind.rlike(r"^(OBJECT|ARRAY)<"), NO_ANALYSIS))
    return requests.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def check_explain_requests(requests: DataFrame) -> DataFrame:
    """All of title, file, line, code and snippet are needed; empty text and line 0 do not count."""
    missing = F.col("line").isNull() | (F.col("line") == 0)
    for c in ("title", "file", "code", "snippet"):
        missing = missing | F.col(c).isNull() | (F.col(c) == "")
    return (requests.withColumn("reason", F.when(missing, NO_EXPLAIN))
            .withColumn("ok", F.col("reason").isNull()))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("ok").drop("ok", "reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("ok"))


def default_path(pasted: DataFrame) -> DataFrame:
    """Trim the path of pasted code or give it the standard one; blank code is not accepted."""
    path = F.coalesce(T.or_null(T.full_trim(F.coalesce("path", F.lit("")))), F.lit(DEFAULT_PASTE_PATH))
    ok = ~blank(F.col("content"))
    return (pasted.withColumn("path", path).withColumn("ok", ok)
            .withColumn("reason", F.when(~ok, F.lit(NO_PASTE))))
