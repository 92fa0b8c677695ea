"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path and fits the host and its subdomains; the
longest that fits decides. URLs that a rule decides are labelled URLs, and the trees
learn from them to judge the others by length, depth, digits, entropy, parameters
and statistics of the host's suffix, its last label, over all URLs.

Nulls and edges: a null URL, or one without ``://``, has an empty host and path, which no
rule fits. Without labelled URLs of both kinds there is nothing to learn and what no rule
decides is allowed. Repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.session import materialized, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path), the rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digits", "hyphens",
            "parameters", "fragment", "entropy", "suffix_length", "suffix_frequency", "suffix_host_length")


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, query (from ``?`` on), suffix."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit(" "), url), "://", 1))
    after = F.when(rest.isNull(), F.lit("")).otherwise(url.substr(F.length(rest) + 3, F.length(url)))
    return (pages.select("page_id", "url", after.alias("after"))
            .withColumn("host", F.translate(F.regexp_extract("after", r"^[^/?#]*", 0), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("after", r"^[^/?#]*([^?#]*)", 1))
            .withColumn("query", F.regexp_extract("after", r"^[^?#]*([^#]*)", 1))
            .withColumn("suffix", F.substring_index("host", ".", -1)).drop("after"))


def deciding_rule(rules: tuple) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits."""
    decided = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        decided = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(decided)
    return decided


def with_features(parts: DataFrame) -> DataFrame:
    """``parts`` with the lexical features, all of them doubles."""
    suffixes = parts.groupBy("suffix").agg(F.log2(F.count(F.lit(1))).alias("suffix_frequency"), F.avg(F.length("host")).alias("suffix_host_length"))
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))

    def share(c: Column) -> Column:
        return (F.length(url) - F.length(F.replace(url, c))) / size

    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0),
                          lambda total, c: total - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    lexical = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "query_length": F.length("query"),
        "host_depth": F.regexp_count("host", F.lit(r"\.")), "path_depth": F.regexp_count("path", F.lit("/")),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size, "host_digits": F.regexp_count("host", F.lit("[0-9]")),
        "hyphens": F.regexp_count("host", F.lit("-")), "parameters": F.regexp_count("query", F.lit("[^?&]+")),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "entropy": entropy, "suffix_length": F.length("suffix")}
    found = parts.select("*", *[c.cast("double").alias(n) for n, c in lexical.items()])
    return found.join(suffixes, "suffix")


def fit_urls(featured: DataFrame, sample: int = 50_000, trees: int = 15, depth: int = 4) -> GBTClassificationModel | None:
    """Trees from the rows of ``featured`` that a rule decides, at most ``sample`` of them, those whose URLs hash lowest."""
    labelled = (featured.where("decided IS NOT NULL").orderBy(F.xxhash64("url"), "page_id").limit(sample)
                .withColumn("label", (F.col("decided.verdict") == "block").cast("double")).select("label", *FEATURES))
    labelled = materialized(labelled.coalesce(4), "labelled")  # bounded, and read once per round of the training
    kinds = labelled.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if kinds["lo"] is None or kinds["lo"] == kinds["hi"]:
        return None
    shared_dir(featured.sparkSession)  # where the training cuts its lineage
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=5).fit(rows)


def filter_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the trees): one row per row of ``pages``."""
    featured = with_features(with_parts(pages)).withColumn("decided", deciding_rule(rules))
    model = fit_urls(featured)
    if model is None:
        judged = featured.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)
        judged = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("decided.rule").alias("rule"),
                         F.coalesce(F.col("decided.verdict"), own).alias("verdict"), "score")
