"""One query per operator, over the given tables or corpora derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.operators import (
    aggregate as A, enrich as E, graph as G, merge as M, metrics as Q, payload as P, prepare, rank, resolve as R,
    roles, scan, structure as S,
)
from corpusguard.plans.analysis import AnalysisResult, analyze, compact_payloads, first_details
from corpusguard.plans.callflow import build_call_flow
from corpusguard.plans.findings import build_findings
from corpusguard.plans.metadata import build_listed, build_metadata
from corpusguard.rules import RULES, RuleSet, severity_table
from corpusguard.session import materialized, scratch_path
from corpusguard.sources import readers, writers
from corpusguard.streaming import incremental
from registry import corpora, probes as probe_data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SELECTED = "src/f1.ts"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n.split(".")[-1]) for n in names]


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def line_files(spark, d):
    return prepare.analyzable(corpora.line_corpus(spark, d))


def code_files(spark, d):
    return prepare.analyzable(corpora.code_corpus(spark, d))


def code_facts(spark, d):
    return S.line_facts(code_files(spark, d))


def code_events(spark, d):
    """Written once, for queries that read it several times."""
    return materialized(S.events(code_files(spark, d)), "events")


def findings(spark, d):
    return build_findings(corpora.line_corpus(spark, d))


# --- sources ---------------------------------------------------------------

@query
def src_corpus(spark, d):
    return corpora.line_corpus(spark, d).select("repo", "file", "seq", F.md5("content").alias("content_md5"))


@query
def src_tree(spark, d):
    kind = F.when(F.col("seq") % 9 == 4, "tree").otherwise("blob")
    tree = corpora.line_corpus(spark, d).select(
        "repo", "seq", kind.alias("type"), F.when(F.col("seq") % 11 != 3, F.col("file")).alias("path"))
    return readers.inventory(tree).select("repo", "seq", "path")


@query
def src_decode(spark, d):
    chunks = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\n")
    encoded = docs(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 13 != 5, chunks).alias("content"),
        F.when(F.col("doc_id") % 7 == 2, "utf-8").when(F.col("doc_id") % 17 != 8, "base64").alias("encoding"))
    return readers.decode_content(encoded).select("doc_id", "content", "error")


@query
def src_repo_url(spark, d):
    return readers.with_repo(probe_data.urls(spark, d)).select("page_id", "owner", "repo_name")


@query
def src_validate(spark, d):
    checked = readers.check_requests(probe_data.urls(spark, d))
    return readers.accepted(checked).select("page_id", F.lit("").alias("reason")).unionByName(
        readers.rejected(checked).select("page_id", "reason"))


@query
def src_validate_payload(spark, d):
    p = F.col("page_id")
    insight = readers.check_insight_requests(probe_data.urls(spark, d).withColumn(
        "analysis", F.when(p % 4 == 0, F.lit('{"a":1}')).when(p % 4 == 1, F.lit("null")).when(p % 4 == 2, F.lit("[]"))))
    explain = readers.check_explain_requests(probe_data.urls(spark, d).select(
        "page_id", F.when(p % 3 != 0, F.lit("t")).alias("title"), F.coalesce("url", F.lit("")).alias("file"),
        (p % 6).cast("int").alias("line"), F.col("url").alias("code"), F.lit("s").alias("snippet")))
    return insight.select("page_id", F.lit("insight").alias("kind"), "ok", "reason").unionByName(
        explain.select("page_id", F.lit("explain").alias("kind"), "ok", "reason"))


@query
def src_default_path(spark, d):
    n = F.col("doc_id")
    pasted = docs(spark, d).select(
        "doc_id", F.when(n % 4 == 0, F.concat(F.lit(" \t"), F.lit("a.js "))).when(n % 4 == 1, F.lit("  ")).when(
            n % 4 == 2, F.lit("b.ts")).alias("path"),
        F.when(n % 6 == 5, F.lit(" \n")).otherwise(F.col("text")).alias("content"))
    return readers.default_path(pasted).select("doc_id", "path", "ok")


@query
def snk_results(spark, d):
    target = scratch_path(spark, "results")
    writers.write_table(findings(spark, d), target)
    back = spark.read.parquet(target)
    return back.select("repo", "id", *big("seq", "line"), "severity")


@query
def snk_tables(spark, d):
    """All result tables of the code corpus, written, read back and counted."""
    paths = writers.write_results(code_result(spark, d), scratch_path(spark, "results"))
    counted = [spark.read.parquet(p).groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(p.rsplit("/", 1)[1]).alias("table"), "repo", "n") for p in paths]
    return reduce(DataFrame.unionByName, counted)


# --- filters and projections -------------------------------------------------

@query
def flt_blank(spark, d):
    n = F.col("doc_id")
    rows = docs(spark, d).select(
        n.alias("seq"), F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 7 == 1, F.lit(" \t")).otherwise(
            F.concat(F.lit("f"), n.cast("string"))).alias("file"),
        F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 5 == 1, F.lit("")).otherwise(F.col("text")).alias("content"))
    return prepare.drop_blank(rows).select("seq", "file", F.length("content").cast("bigint").alias("n_chars"))


@query
def prj_file_type(spark, d):
    n = F.col("doc_id")
    paths = docs(spark, d).select(n.alias("seq"), F.concat("source", F.lit("/f"), n.cast("string"), F.when(n % 4 == 0, ".JS").when(
        n % 4 == 1, "").when(n % 4 == 2, ".d.Ts").otherwise(".x/y")).alias("file"))
    return prepare.with_file_type(paths).select("seq", "file", "file_type")


@query
def flt_extension(spark, d):
    return prepare.keep_extensions(corpora.code_corpus(spark, d)).select("repo", "file", "seq")


@query
def flt_ignored_path(spark, d):
    return prepare.drop_ignored_paths(corpora.line_corpus(spark, d)).select("repo", "file", "seq")


@query
def prj_lines(spark, d):
    return prepare.lines(line_files(spark, d)).select("repo", "file", *big("line_no"), F.md5("line").alias("line_md5"))


@query
def prj_loc(spark, d):
    return prepare.with_loc(line_files(spark, d)).select("repo", "file", *big("loc"))


@query
def flt_suppressed(spark, d):
    return prepare.drop_suppressed(prepare.lines(line_files(spark, d))).select("repo", "file", *big("line_no"))


@query
def flt_comment(spark, d):
    return prepare.drop_comments(prepare.lines(line_files(spark, d))).select("repo", "file", *big("line_no"))


@query
def prj_snippet(spark, d):
    return prepare.with_snippet(prepare.lines(line_files(spark, d))).select("repo", "file", *big("line_no"), "code")


@query
def prj_context(spark, d):
    return prepare.with_context(line_files(spark, d)).select(
        "repo", "file", *big("line_no"), F.md5("context").alias("context_md5"))


# --- scan ------------------------------------------------------------------

@query
def scn_route(spark, d):
    return scan.route(line_files(spark, d), RuleSet()).select("repo", "file", *big("rule_id", "rule_ord"))


@query
def scn_rules(spark, d):
    return scan.hits(line_files(spark, d), RuleSet(), suppress=False).select("repo", "file", *big("line", "rule_id"), "matched")


@query
def scn_secret(spark, d):
    return scan.single_rule_hits(docs(spark, d).select("doc_id", "text"), "text", RULES[0]).select(
        "doc_id", *big("line_no"), "matched", "code")


@query
def scn_suppress(spark, d):
    return scan.hits(line_files(spark, d), RuleSet()).select("repo", "file", *big("line", "rule_id"), "matched")


@query
def scn_finding_id(spark, d):
    return findings(spark, d).select("repo", "seq", "id")


@query
def scn_order(spark, d):
    return scan.in_order(findings(spark, d)).select("repo", "seq", *big("line", "rule_ord"), "id")


@query
def scn_findings(spark, d):
    chain = [F.col(f"attack_chain.{c}").alias(f"chain_{c}") for c in
             ("entry", "entry_evidence", "sink", "sink_evidence", "impact", "location")]
    return findings(spark, d).select(
        "repo", "file", "seq", "id", *big("line", "rule_ord"), "severity", "title", "matched", "code",
        F.md5("context").alias("context_md5"), joined("security_story").alias("security_story"), "story_confidence",
        "scenario", *chain)


# --- enrichment --------------------------------------------------------------

def probes(spark, d):
    return probe_data.probes(spark, d)


def probe_rules(spark, d, *columns):
    return probes(spark, d).join(F.broadcast(RuleSet().table(spark).select("title", *columns)), "title")


@query
def enr_source(spark, d):
    return probes(spark, d).select("doc_id", E.source_label(F.col("context"), F.col("matched")).alias("source"))


@query
def enr_entry(spark, d):
    s = F.col("source")
    return probes(spark, d).select("doc_id", E.entry_point(s).alias("entry"), E.entry_evidence(s).alias("evidence"))


@query
def enr_sink(spark, d):
    return probes(spark, d).select("doc_id", E.sink_evidence(F.col("matched")).alias("sink_evidence"))


@query
def enr_confidence(spark, d):
    source = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return probes(spark, d).select("doc_id", E.confidence(F.col("title"), source, F.col("context")).alias("level"))


@query
def enr_story(spark, d):
    return probe_rules(spark, d, "story").select(
        "doc_id", joined(E.security_story(F.col("story"), F.col("source"))).alias("story"))


@query
def enr_scenario(spark, d):
    return probe_rules(spark, d, "scenario_template").select(
        "doc_id", E.scenario(F.col("scenario_template"), F.col("source")).alias("scenario"))


@query
def enr_chain(spark, d):
    chain = E.attack_chain(F.col("story"), F.col("source"), F.col("matched"), F.col("title"), F.col("doc_id"))
    return probe_rules(spark, d, "story").select("doc_id", chain.alias("c")).select("doc_id", "c.*")


@query
def enr_explain(spark, d):
    return E.explain(probes(spark, d), RuleSet()).select("doc_id", "title", "why", "impact", "fix")


@query
def enr_weight(spark, d):
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    rows = docs(spark, d).select("doc_id", probe_data.pick(levels, F.col("doc_id")).alias("severity"))
    return rows.join(F.broadcast(severity_table(spark)), "severity").select("doc_id", "severity", *big("weight"))


# --- structure -----------------------------------------------------------------

def import_rows(df):
    return df.select("repo", "file", *big("line_no"), "source", "alias", "type", joined("specifiers").alias("specifiers"))


@query
def ext_imports(spark, d):
    return import_rows(S.imports(code_facts(spark, d)))


@query
def ext_bindings(spark, d):
    return S.bindings(S.all_imports(code_facts(spark, d))).select(
        "repo", "file", *big("line_no", "pos"), "source", "imported", "local")


@query
def ext_requires(spark, d):
    return import_rows(S.requires(code_facts(spark, d)))


def export_rows(spark, d, build):
    facts = materialized(code_facts(spark, d), "facts")
    both = [build(facts, v).withColumn("variant", F.lit(v)) for v in S.VARIANTS]
    return both[0].unionByName(both[1]).select("variant", "repo", "file", *big("line_no"), "name", "type", "alias")


@query
def ext_exports(spark, d):
    return export_rows(spark, d, S.exports).where(F.col("type") == "named")


@query
def ext_default_export(spark, d):
    return export_rows(spark, d, S.default_exports)


def function_columns(df):
    return df.select("repo", "file", *big("line_no"), "name", joined("params").alias("params"), "exported", "is_async",
                     "is_arrow", "type")


@query
def ext_functions(spark, d):
    events = code_events(spark, d)
    rows = [S.function_rows(events, v).where(F.col("type") != "method").withColumn("variant", F.lit(v)) for v in S.VARIANTS]
    both = rows[0].unionByName(rows[1])
    return both.select("variant", "repo", "file", *big("line_no"), "name", joined("params").alias("params"), "exported",
                       "is_async", "is_arrow", "type")


@query
def ext_methods(spark, d):
    events = code_events(spark, d)
    rows = [S.method_rows(events, v).withColumn("variant", F.lit(v)) for v in S.VARIANTS]
    return rows[0].unionByName(rows[1]).select("variant", "repo", "file", *big("line_no"), "name",
                                               joined("params").alias("params"), "is_async")


@query
def ext_classes(spark, d):
    return S.classes(S.events(code_files(spark, d)), "detail").select(
        "repo", "file", *big("line_no"), "name", "extends", "exported", joined("methods").alias("methods"))


@query
def ext_params(spark, d):
    rows = S.function_rows(S.events(code_files(spark, d)), "detail")
    return rows.select("repo", "file", *big("line_no"), "name", F.posexplode("params").alias("pos", "param")).select(
        "repo", "file", "line_no", "name", *big("pos"), "param")


@query
def ext_calls(spark, d):
    return S.call_edges(S.events(code_files(spark, d))).select(
        "repo", "file", "caller", "callee", *big("ord.line_no", "ord.pos"))


@query
def ext_file_calls(spark, d):
    return S.file_calls(S.events(code_files(spark, d))).select("repo", "file", "caller", "path", *big("line_no"), "type")


@query
def ext_routes(spark, d):
    return S.routes(code_facts(spark, d)).select("repo", "file", *big("line_no"), "method", "handler")


@query
def ext_merge_symbols(spark, d):
    events = code_events(spark, d)
    rows = [function_columns(S.functions(events, v)).withColumn("variant", F.lit(v)) for v in S.VARIANTS]
    return rows[0].unionByName(rows[1])


@query
def ext_backfill_calls(spark, d):
    events = code_events(spark, d)
    return S.backfill_calls(S.functions(events), S.call_edges(events)).select(
        "repo", "file", "name", joined("calls").alias("calls"))


@query
def ext_deps(spark, d):
    return S.dependencies(code_facts(spark, d)).select("repo", "file", "dependency", *big("line_no"))


@query
def ext_frameworks(spark, d):
    rows = S.framework_signals_by_variant(S.signal_facts(code_files(spark, d)))
    return rows.select("variant", "repo", "file", *big("line_no"), "framework", F.round("weight", 6).alias("weight"), "reason")


@query
def ext_hint_score(spark, d):
    facts = code_facts(spark, d)
    return S.framework_hints(S.framework_signals(facts)).select(
        "repo", "file", "framework", F.round("confidence", 6).alias("confidence"), joined("reason").alias("reason"))


def both_profiles(spark, d):
    files = code_files(spark, d)
    return roles.profiles_by_variant(files, S.signal_facts(files))


@query
def ext_role(spark, d):
    lines = roles.profiles(line_files(spark, d), S.signal_facts(line_files(spark, d))).withColumn("variant", F.lit("lines"))
    return both_profiles(spark, d).unionByName(lines).select("variant", "repo", "file", "module_purpose")


@query
def ext_responsibilities(spark, d):
    return both_profiles(spark, d).select("variant", "repo", "file", joined("responsibilities").alias("responsibilities"))


@query
def ext_confidence(spark, d):
    return both_profiles(spark, d).select("variant", "repo", "file", *big("confidence"))


@query
def ext_status(spark, d):
    return prepare.with_file_type(corpora.code_corpus(spark, d)).select(
        "repo", "file", roles.status(F.col("file_type")).alias("ast_status"))


@query
def ext_metadata(spark, d):
    corpus = corpora.code_corpus(spark, d)
    m = build_metadata(prepare.analyzable(corpus), build_findings(corpus))
    return m.select(
        "repo", "file", "file_type", "module_purpose", *big("confidence"),
        *big("metrics.lines_of_code", "metrics.function_count", "metrics.class_count", "metrics.import_count",
             "metrics.export_count"),
        joined(F.transform("imports", lambda i: F.concat_ws(":", i["source"], i["type"]))).alias("imports"),
        joined(F.transform("exports", lambda e: F.concat_ws(":", e["name"], e["type"]))).alias("exports"),
        joined(F.transform("functions", lambda f: F.concat_ws(":", f["name"], F.array_join(f["calls"], ",")))).alias("functions"),
        joined(F.transform("classes", lambda c: F.concat_ws(":", c["name"], F.array_join(c["methods"], ",")))).alias("classes"),
        joined(F.transform("call_graph", lambda c: F.concat_ws(">", c["caller"], c["callee"]))).alias("call_graph"),
        joined(F.transform("framework_hints", lambda h: h["framework"])).alias("frameworks"),
        joined("finding_titles").alias("finding_titles"), joined("entry_points").alias("entry_points"),
        joined("dependencies").alias("dependencies"))


# --- joins --------------------------------------------------------------------

@query
def jn_file_findings(spark, d):
    return A.files_with_findings(line_files(spark, d).select("repo", "file", "seq"), findings(spark, d)).select(
        "repo", "file", *big("seq"), F.size("findings").cast("bigint").alias("finding_count"),
        joined(F.transform("findings", lambda f: F.concat_ws(":", f["line"].cast("string"), f["title"]))).alias("findings"))


@query
def jn_select_file(spark, d):
    """Findings of one file, next to those of a list of files by semi-join."""
    rows = findings(spark, d)
    one = rows.where(F.col("file") == SELECTED).select(F.lit("one").alias("pick"), "repo", "id")
    listed = line_files(spark, d).where(F.col("file_type") == ".php").select("repo", "file")
    many = rows.join(listed, ["repo", "file"], "left_semi").select(F.lit("list").alias("pick"), "repo", "id")
    return one.unionByName(many)


def code_known(spark, d):
    corpus = corpora.code_corpus(spark, d)
    return R.known_files(corpus, prepare.analyzable(corpus))


@query
def jn_import_path(spark, d):
    imports = S.all_imports(code_facts(spark, d))
    return R.resolve_imports(imports, code_known(spark, d)).select("repo", "file", *big("line_no"), "source", "target")


def flow(spark, d):
    files = code_files(spark, d)
    return build_call_flow(files, code_known(spark, d))


def line_flow(spark, d):
    corpus = corpora.line_corpus(spark, d)
    files = prepare.analyzable(corpus)
    return build_call_flow(files, R.known_files(corpus, files))


@query
def jn_binding(spark, d):
    return flow(spark, d).calls.select("repo", "file", "caller", "callee", "is_local", "target_file", "target_name", "resolved")


@query
def jn_default_export(spark, d):
    facts = materialized(code_facts(spark, d), "facts")
    bound = R.first_bindings(R.resolve_imports(S.all_imports(facts), code_known(spark, d)))
    return R.with_exported_name(bound.where(F.col("imported") == "default"), S.exports(facts, "detail")).select(
        "repo", "file", "local", "target", "exported_name")


@query
def jn_file_call(spark, d):
    code = flow(spark, d).file_calls.select(F.lit("code").alias("corpus"), "repo", "file", "caller", "path", "target")
    return code.unionByName(line_flow(spark, d).file_calls.select(
        F.lit("line").alias("corpus"), "repo", "file", "caller", "path", "target"))


# --- aggregates -----------------------------------------------------------------

def line_result(spark, d) -> AnalysisResult:
    return analyze(corpora.line_corpus(spark, d))


def code_result(spark, d) -> AnalysisResult:
    return analyze(corpora.code_corpus(spark, d))


@query
def agg_severity(spark, d):
    return A.severity_counts(findings(spark, d))


@query
def agg_risk(spark, d):
    return A.risk(findings(spark, d))


@query
def agg_file_risk(spark, d):
    return A.file_risk(findings(spark, d)).select("repo", "file", "count", "risk_score")


def module_columns(df):
    return df.select("repo", "module_purpose", *big("file_count", "finding_count", "risk_score"),
                     joined("top_findings").alias("top_findings"), joined("dependencies").alias("dependencies"),
                     joined("frameworks").alias("frameworks"))


@query
def agg_module(spark, d):
    return module_columns(code_result(spark, d).modules)


@query
def agg_module_files(spark, d):
    return A.module_files(code_result(spark, d).profiles).select("repo", "module_purpose", *big("seq"), "file")


@query
def agg_ordered_distinct(spark, d):
    from corpusguard.functions.skew import first_distinct
    return first_distinct(findings(spark, d), ["repo"], "title", ["seq", "line", "rule_ord"], 7, "titles").select(
        "repo", joined("titles").alias("titles"))


def repo_columns(df):
    return df.select("repo", *big("file_count", "scanned_file_count", "finding_count", "risk_score", "critical", "high",
                                  "medium", "low"),
                     joined("frameworks").alias("frameworks"), joined("dependencies").alias("dependencies"))


@query
def agg_repo(spark, d):
    return repo_columns(code_result(spark, d).repos)


@query
def agg_overview(spark, d):
    r = code_result(spark, d)
    modules = r.profiles.groupBy("repo").agg(F.count_distinct("module_purpose").alias("module_count"))
    return A.overview(r.repos, modules).select("repo", *big("pos"), "label", "value", "subtext")


@query
def agg_titles(spark, d):
    from corpusguard.plans.metadata import titles_per_file
    return titles_per_file(findings(spark, d)).select("repo", "file", joined("finding_titles").alias("finding_titles"))


@query
def agg_graph(spark, d):
    return both_flows(spark, d, lambda g: G.totals(g.functions, g.nodes, g.edges)).select(
        "corpus", "repo", *big("total_functions", "node_count", "edge_count", "entry_nodes", "max_in_degree"))


# --- ranks -----------------------------------------------------------------------

@query
def rnk_hotspots(spark, d):
    return rank.hotspots(A.file_risk(findings(spark, d))).select("repo", *big("rank"), "file", *big("count", "risk_score"))


@query
def rnk_modules(spark, d):
    r = code_result(spark, d)
    ordered = rank.modules_in_order(A.module_counts(r.profiles, r.findings))
    return ordered.select("repo", *big("rank"), "module_purpose", *big("risk_score", "finding_count"))


@query
def rnk_payload_caps(spark, d):
    files = P.payload_files(*first_details(code_result(spark, d)))
    return files.select(
        "repo", "file", *big("rank", "risk"), "module_purpose", joined("entry_points").alias("entry_points"),
        joined("frameworks").alias("frameworks"), joined("dependencies").alias("dependencies"),
        joined(F.transform("findings", lambda f: F.concat_ws(":", f["line"].cast("string"), f["title"]))).alias("findings"))


@query
def rnk_listing(spark, d):
    return rank.listing(corpora.line_corpus(spark, d).select("repo", "file", "seq")).select("repo", "file", *big("seq", "rank"))


@query
def rnk_selected_first(spark, d):
    return rank.selected_first(line_files(spark, d).select("repo", "file", "seq"), SELECTED)


# --- merge -----------------------------------------------------------------------

def two_runs(spark, d):
    """A first run, and a second over three in four files of which every third lost its text."""
    corpus = corpora.line_corpus(spark, d)
    second = corpus.where(F.col("seq") % 4 != 0).withColumn(
        "content", F.when(F.col("seq") % 3 == 0, F.lit("x = 1\n")).otherwise(F.col("content")))
    return corpus, second


@query
def set_known_files(spark, d):
    corpus = corpora.code_corpus(spark, d)
    return R.known_files(corpus.where(F.col("seq") % 3 == 0), prepare.analyzable(corpus)).select("repo", "file")


@query
def set_merge_metadata(spark, d):
    first, second = two_runs(spark, d)
    rows = [M.versioned(prepare.with_loc(prepare.analyzable(c)).select("repo", "file", "seq", "loc"), v)
            for v, c in ((0, first), (1, second))]
    return M.merge_metadata(*rows).select("repo", "file", *big("loc", "version"), F.col("position.version").alias("first_version"),
                                          F.col("position.seq").alias("first_seq"))


def finding_runs(spark, d):
    first, second = two_runs(spark, d)
    keep = ("repo", "file", "seq", "id", "severity", "weight", "line")
    runs = [M.versioned(build_findings(c).select(*keep), v) for v, c in ((0, first), (1, second))]
    return runs, prepare.analyzable(second)


@query
def set_merge_findings(spark, d):
    (old, new), rescanned = finding_runs(spark, d)
    kept = M.merge_findings(old, new).select(F.lit("keep").alias("mode"), "repo", "id", "version")
    replaced = M.merge_findings(old, new, replace=True, rescanned=rescanned).select(
        F.lit("replace").alias("mode"), "repo", "id", "version")
    return kept.unionByName(replaced)


@query
def set_merge_summary(spark, d):
    first, second = two_runs(spark, d)
    (old, new), _ = finding_runs(spark, d)
    merged = M.merge_findings(old, new)
    files = prepare.analyzable(first).select("repo", "file").unionByName(prepare.analyzable(second).select("repo", "file")).distinct()
    known = A.input_counts(first).where(F.col("repo") != "repo3")
    previous = A.input_counts(first).where(F.col("repo") == "repo3").withColumn("file_count", F.lit(0))
    counts = M.known_counts(known, previous, files)
    scanned = files.groupBy("repo").agg(F.count(F.lit(1)).alias("scanned_file_count"))
    return (counts.join(scanned, "repo").join(A.risk(merged, ["repo"]), "repo", "left")
            .join(A.severity_counts(merged), "repo", "left").fillna(0))


# --- graph ------------------------------------------------------------------------

def both_flows(spark, d, build):
    code = build(flow(spark, d)).withColumn("corpus", F.lit("code"))
    return code.unionByName(build(line_flow(spark, d)).withColumn("corpus", F.lit("line")))


@query
def gr_nodes(spark, d):
    return both_flows(spark, d, lambda g: g.nodes.select("repo", "id", "name", "file_path", "kind"))


@query
def gr_call_edges(spark, d):
    return both_flows(spark, d, lambda g: g.edges.where(F.col("label").isNull()).select("repo", "source", "target", "resolved"))


@query
def gr_file_edges(spark, d):
    return both_flows(spark, d, lambda g: g.edges.where(F.col("label") == "HTTP").select("repo", "source", "target", "label", "resolved"))


@query
def gr_caps(spark, d):
    def capped(g):
        nodes, edges, flag = G.cap(g.nodes, g.edges)
        counts = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes")).join(
            edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")), "repo", "left").fillna(0)
        return flag.join(counts, "repo")
    return both_flows(spark, d, capped)


@query
def gr_rank(spark, d):
    return both_flows(spark, d, lambda g: G.ranks(g.nodes, g.edges)).select("corpus", "repo", "id", *big("rank"))


@query
def gr_layout(spark, d):
    g = line_flow(spark, d)
    return G.layout(g.nodes, G.ranks(g.nodes, g.edges)).select("repo", "id", "x", "y")


# --- payloads ----------------------------------------------------------------------

@query
def pay_compact(spark, d):
    """The JSON, read back and flattened."""
    payloads = compact_payloads(code_result(spark, d))
    schema = ("repo struct<fileCount:bigint,riskScore:bigint,frameworks:array<string>,hotspots:array<struct<file:string,riskScore:bigint>>>,"
              "modules array<struct<purpose:string,findingCount:bigint,dependencies:array<string>>>,"
              "files array<struct<path:string,risk:bigint,metrics:struct<linesOfCode:bigint>,findings:array<struct<line:bigint,title:string>>>>")
    j = payloads.select("repo", F.from_json("payload", schema).alias("j"))
    parts = F.array(
        F.concat_ws("|", F.lit("repo"), F.col("j.repo.fileCount").cast("string"), F.col("j.repo.riskScore").cast("string"),
                    F.array_join("j.repo.frameworks", ",")))
    hot = F.transform("j.repo.hotspots", lambda h: F.concat_ws("|", F.lit("hotspot"), h["file"], h["riskScore"].cast("string")))
    mods = F.transform("j.modules", lambda m: F.concat_ws("|", F.lit("module"), m["purpose"], m["findingCount"].cast("string"),
                                                          F.array_join(m["dependencies"], ",")))
    files = F.transform("j.files", lambda f: F.concat_ws(
        "|", F.lit("file"), f["path"], f["risk"].cast("string"), f["metrics"]["linesOfCode"].cast("string"),
        F.array_join(F.transform(f["findings"], lambda x: F.concat_ws(":", x["line"].cast("string"), x["title"])), ",")))
    return j.select("repo", F.explode(F.concat(parts, hot, mods, files)).alias("item"))


@query
def pay_key(spark, d):
    return P.with_key(docs(spark, d).select("doc_id", "text"), F.col("text"), strong=False).select("doc_id", "key")


@query
def pay_cache(spark, d):
    """Snippets of the findings against a cache of what every second file produced; hits get the result stored last."""
    found = materialized(findings(spark, d).select("repo", "seq", "id", "code"), "findings")
    keyed = P.with_key(found, F.col("code"), strong=True)
    cache = keyed.where(F.col("seq") % 2 == 0).select("key", F.concat("repo", F.lit("/"), "id").alias("result"), F.col("seq").alias("stored_at"))
    return P.reuse(keyed, cache).select("repo", "seq", "id", "hit", "result")


@query
def pay_prompt_repo(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(
        "page_id", "url", F.when(F.col("page_id") % 2 == 0, "dev").otherwise("repo").alias("mode"),
        F.to_json(F.struct(F.col("page_id").alias("id"))).alias("payload"))
    return P.prompt_for_repo(pages).select("page_id", "prompt")


@query
def pay_prompt_finding(spark, d):
    return P.prompt_for_finding(findings(spark, d)).select("repo", "id", F.md5("prompt").alias("prompt_md5"))


@query
def pay_listing(spark, d):
    listing = P.listing(build_listed(code_files(spark, d)))
    return listing.select("repo", "file", *[joined(c).alias(c) for c in ("functions", "exports", "classes", "frameworks", "imports")])


# --- streaming -----------------------------------------------------------------------

def document_stream(spark, d, path=None):
    """The line corpus over a stream of ``documents``."""
    schema = docs(spark, d).schema
    return corpora.line_corpus_from(spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]"))


@query
def str_scan(spark, d):
    out, marks = scratch_path(spark, "stream-findings"), scratch_path(spark, "stream-marks")
    incremental.run(incremental.write_findings(document_stream(spark, d), out, marks))
    return spark.read.parquet(out).select("repo", "id", *big("seq", "line"), "severity", "story_confidence")


def logged(spark, d):
    log, marks = scratch_path(spark, "log"), scratch_path(spark, "log-marks")
    incremental.run(incremental.log_batches(document_stream(spark, d), log, marks))
    return log


@query
def str_merge(spark, d):
    log = logged(spark, d)
    f = incremental.merged_findings(spark, log).select(F.lit("finding").alias("kind"), "repo", F.col("id").alias("key"), F.col("severity").alias("value"))
    m = incremental.merged_profiles(spark, log).select(F.lit("file").alias("kind"), "repo", F.col("file").alias("key"), F.col("module_purpose").alias("value"))
    return f.unionByName(m)


@query
def str_summary(spark, d):
    return incremental.summary(spark, logged(spark, d)).select(
        "repo", *big("file_count", "scanned_file_count", "finding_count", "risk_score", "critical", "high", "medium", "low"))


# --- metrics ----------------------------------------------------------------------------

def secret_outcomes(spark, d):
    texts = docs(spark, d).select("doc_id", "lang", F.col("text").alias("content"))
    items = prepare.with_loc(texts).select("doc_id", "lang", "loc")
    alerts = scan.single_rule_hits(texts.withColumnRenamed("content", "text").select("doc_id", "text"), "text", RULES[0])
    truth = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (F.col("quality") == 0).alias("vulnerable"))
    return Q.outcomes(items, alerts, truth, "doc_id")


@query
def ev_scores(spark, d):
    return Q.scores(secret_outcomes(spark, d))


@query
def ev_density(spark, d):
    return Q.false_alert_density(secret_outcomes(spark, d))


@query
def ev_by_group(spark, d):
    rates = Q.detection_rate(findings(spark, d), line_files(spark, d).select("repo", "file", "file_type"))
    return rates.select("file_type", "title", *big("files", "files_hit"), "rate")
