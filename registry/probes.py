"""Small-variety columns over ``documents``, for operators on single fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.rules import RULES
from registry.corpora import q

HEADERS = ["x = 1", "function f(a, b)", "function g()", "def run(cmd):", "void main(int argc)", "public int go(String s)",
           "const h = function (\n  req\n)"]
SOURCE_TEXTS = ["y = 2", "a = req.body.name", "b = req.query.id", "c = req.params.p", "d = process.env.HOME",
                "e = request.args.get('x')", "f = request.form['y']", "g = request.json", "h = $_GET['q']",
                "i = $_COOKIE[\"s\"] + $_POST['z']", "j = Request.Params[\"k\"]", "k = request.getParameter(\"n\")",
                "l = Request.Query[\"m\"]", "m = $_REQUEST[0]", "n = prereq.body.x", "o = request.args + request.json[0]"]
MATCHES = ["exec(", "execSync(", "subprocess.run(", "SUBPROCESS.Call(x", ".innerHTML =", "dangerouslySetInnerHTML={{",
           "document.write(m)", "yaml.load(", "pickle.loads(", "unserialize($_COOKIE", "mysqli_query($c, $_GET", "new SqlCommand(",
           "Path.Combine(", "File.Open(", "Runtime.getRuntime().exec(", "ProcessBuilder(", "Process.Start(", "shell_exec(",
           "é eval(", "_eval(", "assert(", "spawnSync("]
TITLES = [r.title for r in RULES] + ["Custom Rule"]
SOURCES = [None] + [t.split("= ", 1)[1] for t in SOURCE_TEXTS[1:]] + ["REQ.QUERY.a", "custom.input"]
URLS = ["{url}", "https://github.com/owner{id}/name{id}.git", "HTTPS://WWW.GitHub.com/o{id}/r{id}/tree/main", "https://github.com/only{id}",
        "https://github.com/owner{id}/", "not a url {id}", "https://github.com.evil.net/a{id}/b", "http://github.com:8080/a{id}/b.git?x=1#y",
        "ssh://git@github.com/a{id}/b.git", "   ", ""]


def pick(values: list, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position % len(values) + 1).cast("int"))


def pick_sql(values: list, position: str) -> str:
    items = ", ".join("NULL" if v is None else q(v) for v in values)
    return f"([{items}])[({position}) % {len(values)} + 1]"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, context, matched, source. The table may have few row groups, so its rows are dealt to all tasks."""
    d = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id").select(
        "doc_id", pick(TITLES, d).alias("title"),
        F.concat(pick(HEADERS, d), F.lit("\n"), pick(SOURCE_TEXTS, d), F.lit("\n"), F.col("text")).alias("context"),
        pick(MATCHES, d).alias("matched"), pick(SOURCES, d).alias("source"))


def probes_sql() -> str:
    return f"""probes AS MATERIALIZED (SELECT doc_id, {pick_sql(TITLES, 'doc_id')} AS title,
  {pick_sql(HEADERS, 'doc_id')} || chr(10) || {pick_sql(SOURCE_TEXTS, 'doc_id')} || chr(10) || text AS context,
  {pick_sql(MATCHES, 'doc_id')} AS matched, {pick_sql(SOURCES, 'doc_id')} AS source FROM documents)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, path: page addresses next to repository addresses."""
    p = F.col("page_id")
    template = pick(URLS, p)
    made = F.replace(F.replace(template, F.lit("{url}"), F.col("url")), F.lit("{id}"), p.cast("string"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.when(p % 23 != 22, made).alias("url"),
        F.when(p % 5 == 0, F.lit(" \t")).when(p % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("src/p"), p.cast("string"), F.lit(".js"))).alias("path"))


def urls_sql() -> str:
    return f"""urls AS MATERIALIZED (SELECT page_id,
  CASE WHEN page_id % 23 <> 22 THEN replace(replace({pick_sql(URLS, 'page_id')}, '{{url}}', url), '{{id}}', CAST(page_id AS VARCHAR)) END AS url,
  CASE page_id % 5 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN NULL ELSE 'src/p' || page_id || '.js' END AS path FROM pages)"""
