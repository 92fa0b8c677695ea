"""A weather station with a panel, a unit module and a Python archive; expectations worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

import corpusguard as cg
from corpusguard.operators import aggregate as A, graph as G, merge as M, payload as P, prepare, resolve as R, roles, structure as S
from corpusguard.plans.analysis import compact_payloads

UNITS = """export const celsius = (f) => (f - 32) / 1.8

export function label(value, unit = 'C') {
  return value + unit
}
"""
ARCHIVE = """import os, pickle

def restore(path):
    rows = pickle.loads(open(path, 'rb').read())
    os.system(request.args.get('after'))
    return rows

token = 'only-for-the-test-9'
"""
PANEL = """import { celsius, label as text } from './units'
import React from 'react'

export default function Panel(props) {
  const shown = text(celsius(props.raw))
  document.write(shown)
  return <b dangerouslySetInnerHTML={{ __html: shown }} />
}

function refresh() {
  fetch('/station/archive.py')
  notify(Panel)
}
"""
FILES = (("station/units.js", UNITS), ("station/archive.py", ARCHIVE), ("dist/old.js", "eval(a)"), ("station/panel.jsx", PANEL),
         ("readme.txt", "os.system(a)"))


@pytest.fixture(scope="module")
def result(spark, corpus_of):
    return cg.analyze(corpus_of(*FILES))


def test_findings(result):
    rows = result.findings.orderBy("seq", "line", "rule_ord").collect()
    given = "request.args.get('after')"
    assert [(r.file, r.line, r.rule_id, r.severity, r.story_confidence, r.source) for r in rows] == [
        ("station/archive.py", 4, 12, "CRITICAL", "High", given),
        ("station/archive.py", 5, 10, "CRITICAL", "High", given),
        ("station/archive.py", 8, 1, "HIGH", "Medium", None),
        ("station/panel.jsx", 6, 8, "HIGH", "Medium", None),
        ("station/panel.jsx", 7, 7, "HIGH", "Low", None)]
    chain = rows[1].attack_chain
    assert (chain.entry, chain.entry_evidence, chain.sink, chain.sink_evidence, chain.impact, chain.location) == (
        "User Input", "query parameter", "shell execution", "system", "Remote Shell Access", "station/archive.py:5")
    assert list(rows[0].security_story) == [given, "pickle.loads()", "Remote Code Execution"]
    assert rows[3].scenario == ("An attacker supplies HTML or script through an unvalidated input. It is rendered through document.write(), "
                                "enabling cross-site scripting.")


def test_summary(result):
    repo = result.repos.first()
    assert (repo.file_count, repo.scanned_file_count, repo.finding_count, repo.risk_score) == (5, 3, 5, 10 + 10 + 3 * 5)
    assert (repo.critical, repo.high, repo.medium, repo.low) == (2, 3, 0, 0)
    assert (list(repo.frameworks), list(repo.dependencies)) == (["React"], ["units"])
    assert [(h.rank, h.file, h["count"], h.risk_score) for h in result.hotspots.orderBy("rank").collect()] == [
        (1, "station/archive.py", 3, 25), (2, "station/panel.jsx", 2, 10)]
    modules = {m.module_purpose: m for m in result.modules.collect()}
    assert {k: (m.rank, m.file_count, m.finding_count, m.risk_score) for k, m in modules.items()} == {
        "Authentication Module": (1, 1, 3, 25), "UI Component": (2, 1, 2, 10), "General Utility": (3, 1, 0, 0)}
    assert list(modules["UI Component"].dependencies) == ["units"] and list(modules["UI Component"].frameworks) == ["React"]
    assert list(modules["Authentication Module"].top_findings) == [
        "Python Insecure Deserialization", "Python Command Injection", "Hardcoded Secret"]


def test_metadata(result):
    rows = {r.file: r for r in result.metadata.collect()}
    panel, units = rows["station/panel.jsx"], rows["station/units.js"]
    assert (panel.metrics.import_count, panel.metrics.function_count, panel.metrics.export_count, panel.metrics.lines_of_code) == (2, 2, 1, 11)
    assert [(f.name, list(f.params), list(f.calls)) for f in panel.functions] == [
        ("Panel", ["props"], ["text", "celsius", "write"]), ("refresh", [], ["fetch", "notify"])]
    assert list(panel.entry_points) == ["Panel"] and list(panel.dependencies) == ["units"]
    assert [(f.name, list(f.params), f.type) for f in units.functions] == [("celsius", ["f"], "arrow"), ("label", ["value", "unit"], "function")]
    assert units.confidence == 40 + 2 * 4 and panel.confidence == 40 + 2 * 8 + 2 * 4 + 6
    assert rows["station/archive.py"].metrics.lines_of_code == 6 and rows["station/archive.py"].functions == []


def test_risks_add_up(result):
    files = A.file_risk(result.findings).agg(F.sum("risk_score")).first()[0]
    modules = result.modules.agg(F.sum("risk_score"), F.sum("finding_count")).first()
    repo = result.repos.first()
    assert files == modules[0] == repo.risk_score and modules[1] == repo.finding_count


def test_severity_counts_are_zero_filled(spark, corpus_of):
    quiet = cg.analyze(corpus_of(("a.py", "x = 1"))).repos.first()
    assert (quiet.finding_count, quiet.risk_score, quiet.critical, quiet.low) == (0, 0, 0, 0)
    assert A.risk(cg.build_findings(corpus_of(("a.py", "x = 1")))).first().risk_score == 0


def test_payload(result):
    payload = json.loads(compact_payloads(result).first().payload)
    assert list(payload) == ["repo", "modules", "files"]
    assert payload["repo"]["severityCounts"] == {"CRITICAL": 2, "HIGH": 3, "MEDIUM": 0, "LOW": 0}
    assert [f["path"] for f in payload["files"]] == ["station/units.js", "station/archive.py", "station/panel.jsx"]
    assert payload["files"][1]["findings"][2] == {"title": "Hardcoded Secret", "severity": "HIGH", "line": 8, "code": "token = 'only-for-the-test-9'"}
    assert payload["files"][2]["entryPoints"] == ["Panel"] and payload["files"][2]["frameworks"] == ["React"]
    assert [m["riskScore"] for m in payload["modules"]] == [25, 10, 0]
    assert payload["repo"]["hotspots"][0] == {"file": "station/archive.py", "count": 3, "riskScore": 25}


def edges_of(flow):
    return sorted((e.source.split(":")[-1], e.target, e.label or "", e.resolved) for e in flow.edges.collect())


def test_call_flow_over_all_files(spark, corpus_of):
    corpus = corpus_of(*FILES)
    files = prepare.analyzable(corpus)
    flow = cg.build_call_flow(files, R.known_files(corpus, files))
    assert edges_of(flow) == [
        ("Panel", "external:station/panel.jsx:write", "", False), ("Panel", "function:station/units.js:celsius", "", True),
        ("Panel", "function:station/units.js:label", "", True), ("refresh", "external:station/panel.jsx:notify", "", False),
        ("refresh", "file:station/archive.py", "HTTP", True)]
    ranks = {r.id.split(":")[-1]: r["rank"] for r in G.ranks(flow.nodes, flow.edges).collect()}
    assert ranks == {"Panel": 0, "refresh": 0, "celsius": 1, "label": 1, "write": 1, "notify": 1, "station/archive.py": 1}


def test_call_flow_with_one_file_opened(spark, corpus_of):
    corpus = corpus_of(*FILES)
    opened = prepare.analyzable(corpus).where("file = 'station/panel.jsx'")
    flow = cg.build_call_flow(opened, R.known_files(corpus, opened))
    assert [(s, t, r) for s, t, _, r in edges_of(flow)] == [
        ("Panel", "external:station/panel.jsx:write", False), ("Panel", "external:station/units.js:celsius", False),
        ("Panel", "external:station/units.js:text", False), ("refresh", "external:station/panel.jsx:notify", False),
        ("refresh", "file:station/archive.py", False)]
    kinds = {n.id: n.kind for n in flow.nodes.collect()}
    assert kinds["file:station/archive.py"] == "external" and kinds["function:station/panel.jsx:Panel"] == "function"


def test_cycles_rank_last_and_caps_flag(spark):
    nodes = spark.createDataFrame([("r", x, i) for i, x in enumerate("abcxy")], "repo string, id string, o int").select(
        "repo", "id", F.struct(F.lit(0).alias("phase"), F.col("o").cast("bigint").alias("seq")).alias("node_ord"))
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "a", "c"), ("r", "x", "y"), ("r", "y", "x")],
                                  "repo string, source string, target string").withColumn("id", F.concat("source", "target"))
    ranked = G.ranks(nodes, edges)
    assert {r.id: r["rank"] for r in ranked.collect()} == {"a": 0, "b": 1, "c": 1, "x": 2, "y": 2}
    places = {r.id: (r.x, r.y) for r in G.layout(nodes, ranked).collect()}
    assert places == {"a": (0, 0), "b": (250, 0), "c": (250, 105), "x": (500, 0), "y": (500, 105)}
    few, kept, flag = G.cap(nodes, edges.withColumn("edge_ord", F.col("id")), 3, 2)
    assert few.count() == 3 and kept.count() == 2 and flag.first().truncated


def test_path_lookups(spark):
    known = spark.createDataFrame([("r", p) for p in ("a/b.ts", "a/b/index.js", "a/c.js", "lib\\d.ts", "x/same.php", "y/same.php", "z/only.php")], "repo string, file string")
    imports = spark.createDataFrame([("r", "a/m.ts", 0, s) for s in ("./b", "./b/index", "../a/c.js", "/lib/d", "../../../z/only.php", "./none", "react", ".")],
                                    "repo string, file string, seq int, source string")
    got = {r.source: r.target for r in R.resolve_imports(imports, known).collect()}
    assert got == {"./b": "a/b.ts", "./b/index": "a/b/index.js", "../a/c.js": "a/c.js", "/lib/d": "lib/d.ts", "../../../z/only.php": "z/only.php",
                   "./none": None, "react": None, ".": None}
    calls = spark.createDataFrame([("r", "a/m.ts", 0, "root", p) for p in ("/only.php?x=1", "same.php", "https://h.example/z/only.php#a", "/x/same.php", "../a/c.js")],
                                  "repo string, file string, seq int, caller string, path string")
    got = {r.path: r.target for r in R.resolve_file_calls(calls, known).collect()}
    assert got == {"/only.php?x=1": "z/only.php", "same.php": None, "https://h.example/z/only.php#a": "z/only.php", "/x/same.php": "x/same.php", "../a/c.js": "a/c.js"}


def test_structure_subset(spark, corpus_of):
    text = """import def, * as ns from 'm'
import {} from 'n'
const { a, b: c, ...rest } = require('p')
const q = require('r').s
class A extends B {
  constructor(x) { super(x) }
  async go(y) {
    this.z().w()
    if (y) { new Q(y) }
  }
}
function after() { return go('eval(1)') } // eval(2)
export default class extends A {
}
router.use(authenticate)
"""
    facts = S.line_facts(prepare.analyzable(corpus_of(("a.js", text))))
    imports = [(r.source, r.alias, r.type, list(r.specifiers)) for r in S.all_imports(facts).orderBy("line_no").collect()]
    assert imports == [("m", "ns", "namespace", ["def", "*"]), ("n", None, "side-effect", []), ("p", None, "require", ["a", "b"])]
    events = S.scoped(facts)
    edges = {(r.caller, r.callee) for r in S.call_edges(events).collect()}
    assert edges == {("root", "require"), ("A.go", "z"), ("A.go", "w"), ("after", "go"), ("root", "use")}
    assert [(r.name, r.type) for r in S.exports(facts).collect()] == [("default", "default")]
    assert S.exports(facts, "detail").count() == 0
    assert [(r.name, r.extends, list(r.methods)) for r in S.classes(events).collect()] == [("A", "B", ["constructor", "go"])]
    assert [r.name for r in S.entry_points(facts).orderBy("line_no").collect()] == ["default", "authenticate"]


def structure_of(corpus_of, text):
    facts = S.line_facts(prepare.analyzable(corpus_of(("a.ts", text))))
    events = S.scoped(facts)
    return facts, events, sorted((r.caller, r.callee) for r in S.call_edges(events).collect())


def test_statements_over_several_lines(corpus_of):
    facts, events, edges = structure_of(corpus_of, """import {
  one, // the first
  two as second
} from './numbers'
export {
  one,
  second as last
} from './numbers'
const {
  read,
  write: put
} = require('fs')
export function many(
  a = f(g(1)),
  { b, c } = {},
  ...rest
) {
  return put(a)
}
""")
    assert [(r.line_no, r.source, list(r.specifiers)) for r in S.all_imports(facts).orderBy("line_no").collect()] == [
        (1, "./numbers", ["one", "two"]), (9, "fs", ["read", "write"])]
    assert [(r.line_no, r.name) for r in S.exports(facts).orderBy("line_no", "pos").collect()] == [(5, "one"), (5, "last"), (13, "many")]
    assert [(r.name, r.line_no, list(r.params)) for r in S.functions(events).collect()] == [("many", 13, ["a", "...rest"])]
    assert ("many", "put") in edges and ("root", "put") not in edges


def test_long_headers_are_functions(corpus_of):
    defaults = ", ".join(f"p{i} = d({i})" for i in range(300))
    _, events, _ = structure_of(corpus_of, f"function wide({defaults}) {{\n  x()\n}}\n")
    assert [(r.name, len(r.params)) for r in S.functions(events).collect()] == [("wide", 300)]


def test_nested_functions_give_back_the_scope(corpus_of):
    _, _, edges = structure_of(corpus_of, """function outer() {
  const inner = () => {
    first()
  }
  if (ready()) {
    items.map((x) => {
      third(x)
    })
  }
  second()
}
class Box {
  open(key) {
    const turn = (k) => {
      unlock(k)
    }
    lift()
  }
  shut() {
    lock("}")
  }
}
last()
""")
    assert edges == [("Box.open", "lift"), ("Box.shut", "lock"), ("inner", "first"), ("outer", "map"), ("outer", "ready"),
                     ("outer", "second"), ("outer", "third"), ("root", "last"), ("turn", "unlock")]


def test_comments_and_templates_are_no_code(corpus_of):
    _, _, edges = structure_of(corpus_of, """/* phantom(1)
 * calls ghost(x)
 */
// shade(2)
const text = `it says boo(3) and ${told(4)}
  more(5)`
real('https://host/a(b)') // not(6)
fetch(`/x/y.py`)
""")
    assert edges == [("root", "fetch"), ("root", "real"), ("root", "told")]


def test_merge_is_idempotent_and_keeps_positions(spark):
    schema = "repo string, file string, seq bigint, v string, version bigint"
    old = spark.createDataFrame([("r", "a", 0, "1", 0), ("r", "b", 1, "1", 0)], schema)
    new = spark.createDataFrame([("r", "a", 5, "2", 1), ("r", "c", 6, "2", 1)], schema)
    merged = M.merge_metadata(old, new)
    rows = [(r.file, r.v, r.version) for r in merged.orderBy("position").collect()]
    assert rows == [("a", "2", 1), ("b", "1", 0), ("c", "2", 1)]
    again = M.merge_metadata(merged.drop("position"), new)
    assert sorted((r.file, r.v, r.version) for r in again.collect()) == sorted(rows)


def test_cache_misses_and_keys(spark):
    payloads = spark.createDataFrame([("u", "repo", "{}"), ("u", "dev", "{}"), ("w", "repo", "{}")], "url string, mode string, payload string")
    keyed = P.with_key(payloads, P.cache_text(payloads))
    text = payloads.select(P.cache_text(payloads).alias("t")).first().t
    assert text == '{"repoUrl":"u","devMode":false,"compactPayload":{}}'
    cached = keyed.where("url = 'u' and mode = 'repo'")
    misses = P.cache_misses(keyed, cached)
    assert sorted((r.url, r.mode) for r in misses.collect()) == [("u", "dev"), ("w", "repo")]


def test_paste_mode(spark):
    result = cg.analyze_text(spark, "pasted-file.js", "eval(a)\n")
    assert result.findings.count() == 1 and result.repos.first().file_count == 1


def test_cached_results_come_back(spark, monkeypatch):
    payloads = spark.createDataFrame([(f"k{i}", i) for i in range(4000)] + [("k1", 9001), (None, 9002)], "key string, n int")
    cache = spark.createDataFrame([(f"k{i}", f"old{i}", 1) for i in range(0, 1500, 3)] + [(f"k{i}", f"new{i}", 2) for i in range(0, 30, 3)]
                                  + [("k3", "newer", 2), (None, "none", 9)], "key string, result string, stored_at int")
    want = {(r["key"], r.n): r.result for r in payloads.join(cache.where("false"), "key", "left").collect()}
    for i in range(0, 1500, 3):
        want[f"k{i}", i] = "newer" if i == 3 else f"new{i}" if i < 30 else f"old{i}"

    def rows(df):
        found = df.select("key", "n", "hit", "result").collect()
        assert all(r.hit == (r.result is not None) for r in found) and len(found) == payloads.count()
        return {(r["key"], r.n): r.result for r in found}
    assert rows(P.reuse(payloads, cache)) == want
    told = P._possible(payloads, P.key_sketch(cache.dropna().dropDuplicates(["key"])), "key")
    assert told.where("_maybe").count() < 500 + 100 and told.where("NOT _maybe").join(cache, "key", "left_semi").isEmpty()
    monkeypatch.setattr(P, "SKETCH_BYTES", 0)  # too large to send: the plain way, the same rows
    assert rows(P.reuse(payloads, cache)) == want
    monkeypatch.undo()
    assert not P.reuse(payloads, cache.limit(0)).where("hit").count() and P.reuse(payloads.limit(0), cache).count() == 0


def test_only_what_is_asked_for_is_scanned(corpus_of):
    from corpusguard.operators import payload as P
    from corpusguard.plans.analysis import first_details
    result = cg.analyze(corpus_of(*FILES))
    assert result.repos.first().scanned_file_count == 3
    assert "profiles" not in result.__dict__
    result = cg.analyze(corpus_of(*FILES))
    assert result.profiles.count() == 3 and "findings" not in result.__dict__
    # the first files alone, and their findings, give the same rows as the details of all files
    few = P.payload_files(*first_details(result)).drop("rank").collect()
    assert not {"metadata", "findings"} & result.__dict__.keys()
    every = P.payload_files(result.metadata, result.findings).drop("rank").collect()
    assert sorted(map(repr, few)) == sorted(map(repr, every)) and len(few) == 3


def test_ranks_of_modules_need_no_lists(corpus_of):
    from corpusguard.operators import rank
    result = cg.analyze(corpus_of(*FILES))
    columns = ["repo", "rank", "module_purpose", "risk_score", "finding_count"]
    ranked = rank.modules_in_order(A.module_counts(result.profiles, result.findings)).select(*columns).collect()
    assert sorted(ranked) == sorted(result.modules.select(*columns).collect()) and len(ranked) == 3


def test_roles_and_frameworks_of_both_variants_take_one_scan(spark, corpus_of):
    from registry.corpora import MODULES
    files = prepare.analyzable(corpus_of(*[(p.replace("{m}", "0"), t.replace("{m}", "0")) for _, p, t in MODULES], ("a.ts", "x")))
    lean, full = S.signal_facts(files), S.events(files)
    both, signals = roles.profiles_by_variant(files, lean), S.framework_signals_by_variant(lean)
    for df in (both, signals):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert "params" not in lean.schema.simpleString() and "calls" not in lean.columns
    for v in S.VARIANTS:
        for got, want in ((both, roles.profiles(files, full, v)), (signals, S.framework_signals(full, v))):
            rows = got.where(F.col("variant") == v).select(*want.columns).collect()
            assert sorted(rows, key=str) == sorted(want.collect(), key=str) and rows


def test_summaries_need_no_calls_or_parameters(corpus_of, monkeypatch):
    def never(*args):
        raise AssertionError("the full structure was read")
    monkeypatch.setattr(S, "events", never)
    r = cg.analyze(corpus_of(("src/login.ts", "import e from 'express'\nexport function f(a) { g(a) }\n")))
    assert [x.frameworks for x in r.repos.collect()] == [["Express"]] and r.modules.count() == r.profiles.count() == 1


def _modules(corpus_of):
    from registry.corpora import MODULES
    twice = ("src/twice.ts", "class A { m() { f() } }\nfunction g(a) { h(); b() }\nasync function g(b, c) { b(); h(); k() }\n"
             "export class A extends B { m() { f() } n() {} }\nexport const q = 1; export { g as q, q as r }\nfetch('x.js'); fetch('x.js')\n")
    return corpus_of(*[(p.replace("{m}", "0"), t.replace("{m}", "0")) for _, p, t in MODULES], twice, ("a.ts", ""), ("b.py", "import jwt\n"),
                     ("c.ts", "export class T {}\nT()\n"))


def test_metadata_takes_one_scan_and_one_shuffle(spark, corpus_of):
    from corpusguard.plans.metadata import build_metadata
    files, none = prepare.analyzable(_modules(corpus_of)), cg.build_findings(corpus_of(("none.txt", "")))
    for v in S.VARIANTS:
        alone = build_metadata(files, none, variant=v)
        text = alone._jdf.queryExecution().executedPlan().toString()
        assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning(repo#") <= 4
        given = build_metadata(files, none, S.events(files), v, roles.profiles(files, S.events(files), v))
        assert sorted(alone.collect(), key=str) == sorted(given.select(alone.columns).collect(), key=str) and alone.count() == files.count()


def test_lists_of_a_file_are_its_relations(spark, corpus_of):
    from corpusguard.plans.metadata import build_metadata
    corpus = _modules(corpus_of)
    files, events = prepare.analyzable(corpus), S.events(prepare.analyzable(corpus))
    for v in S.VARIANTS:
        rows = build_metadata(files, cg.build_findings(corpus), variant=v).collect()
        edges = S.call_edges(events, v)

        def flat(df, *columns):
            return sorted((str([r.file, *[r[c] for c in columns]]) for r in df.collect()))

        def listed(name, *fields):
            return sorted(str([r.file, *[e[f] for f in fields]]) for r in rows for e in r[name])
        fields = ["name", "params", "exported", "calls", "is_async", "is_arrow", "type"]
        assert listed("functions", "line", *fields) == flat(S.backfill_calls(S.functions(events, v), edges), "line_no", *fields)
        fields = ["name", "extends", "exported", "methods"]
        assert listed("classes", "line", *fields) == flat(S.classes(events, v), "line_no", *fields)
        assert listed("call_graph", "caller", "callee", "type") == flat(edges, "caller", "callee", "type")
        assert listed("exports", "line", "name", "type", "alias") == flat(S.exports(events, v), "line_no", "name", "type", "alias")
        fields = ["source", "alias", "type", "specifiers", "bindings"]
        assert listed("imports", "line", *fields) == flat(S.all_imports(events), "line_no", *fields)
        assert listed("framework_hints", "framework", "confidence", "reason") == flat(
            S.framework_hints(S.framework_signals(events, v), v), "framework", "confidence", "reason")
        assert sorted(str([r.file, n]) for r in rows for n in r.entry_points) == flat(S.entry_points(events, v), "name")
        assert sorted(str([r.file, n]) for r in rows for n in r.dependencies) == flat(S.dependencies(events), "dependency")
        if v == "detail":
            assert listed("file_calls", "caller", "path", "type") == flat(S.file_calls(events), "caller", "path", "type")
        twice = next(r for r in rows if r.file == "src/twice.ts")
        assert [(f.name, list(f.calls)) for f in twice.functions if f.name == "g"] == [("g", ["h", "b", "k"])]
        assert [(c.name, c.extends, c.exported, list(c.methods)) for c in twice.classes] == [("A", None, True, ["m", "n"])]


def test_listing_needs_neither_roles_nor_calls(spark, corpus_of):
    from corpusguard.operators import payload as P
    from corpusguard.plans.metadata import build_listed, build_metadata
    corpus = _modules(corpus_of)
    files = prepare.analyzable(corpus)
    lean = build_listed(files)
    assert "calls:array" in lean.schema.simpleString() and "call_graph" not in lean.columns
    plan = lean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    whole = P.listing(build_metadata(files, cg.build_findings(corpus), variant="detail"))
    assert sorted(P.listing(lean).collect(), key=str) == sorted(whole.collect(), key=str) and whole.count() == files.count()


def test_names_of_a_large_file_are_merged_in_linear_time(spark, corpus_of):
    from corpusguard.plans.metadata import nested
    text = "".join(f"function f{i % 9000}(a{i}) {{ f{(i * 7) % 9000}(a) }}\n" for i in range(18000))
    row = nested(S.events(prepare.analyzable(corpus_of(("big.js", text))))).first()
    assert len(row.functions) == 9000 and [len(f.calls) for f in row.functions[:3]] == [0, 1, 1]
    assert len(row.call_graph) == 9000 - sum((i * 7) % 9000 == i for i in range(9000))
