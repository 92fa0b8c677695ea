"""The rule catalogue, line by line, and its traps."""

import pytest
from pyspark.sql import functions as F

from corpusguard.operators import prepare, scan
from corpusguard.plans.findings import build_findings
from corpusguard.rules import RULES, Rule, RuleSet, register_rules
from registry.corpora import EXPECTED, NBSP, SAMPLES


def rule_ids(spark, corpus_of, *files):
    rows = build_findings(corpus_of(*files)).select("file", "line", "rule_id").collect()
    return sorted((r.file, r.line, r.rule_id) for r in rows)


def test_sample_lines(spark, corpus_of):
    found = rule_ids(spark, corpus_of, *[(f"f{s}{e}", line) for s, e, line in SAMPLES])
    wanted = sorted((f"f{s}{e}", 1, r) for s, e, _ in SAMPLES for r in EXPECTED[s])
    assert found == wanted


def test_every_rule_is_routed():
    pairs = [(e, r.rule_id) for r in RULES for e in r.extensions]
    assert len(pairs) == len(set(pairs)) == 75
    assert {r.rule_id for r in RULES} == set(range(1, 33))


@pytest.mark.parametrize("line,ext,ids", [
    ('printf( "x")', ".c", [26]),              # the space lets the pattern back off
    ('printf("x")', ".c", []),
    ('fprintf(stderr, "x")', ".c", [26]),
    ("sprintf(a, b)", ".h", [25, 26]),
    ("#define X gets(a)", ".c", []),           # '#' starts a comment in every language
    ("*p = gets(a);", ".c", []),
    (f"{NBSP}// eval(x)", ".js", []),          # wide white space before the marker
    ("étoken = 'abcdefgh1'", ".js", [1]),      # ASCII boundary
    ("mytoken = 'abcdefgh1'", ".js", []),
    ("TOKEN = 'abcdefgh1'", ".py", [1]),
    ("x = yaml.load(a); y = yaml.load(b, Loader=yaml.SafeLoader)", ".py", [13]),
    ("exec(`a ${b}`); spawn(c, { shell: true })", ".ts", [3, 4]),
    ("eval(x) // SCAN-IGNORE", ".js", [5]),    # the mark is case-sensitive
    ("new File('a')", ".java", []),
    ("new File(a)", ".java", [29]),
])
def test_traps(spark, corpus_of, line, ext, ids):
    assert [r for _, _, r in rule_ids(spark, corpus_of, ("a" + ext, line))] == ids


def test_context_is_clamped_and_keeps_comments(spark, corpus_of):
    text = "eval(a)\r\n// note\nb\nc\neval(d)"
    rows = build_findings(corpus_of(("a.js", text))).orderBy("line").collect()
    assert [(r.line, r.context) for r in rows] == [(1, "eval(a)\n// note\nb"), (5, "b\nc\neval(d)")]


def test_long_line_is_cut(spark, corpus_of):
    row = build_findings(corpus_of(("a.js", "  eval(" + "x" * 200 + ")"))).first()
    assert row.code == "eval(" + "x" * 115 + "... [truncated]"
    assert row.id == "a.js:1:JS/TS Dynamic Evaluation:eval("


def test_prefilter_changes_nothing(spark, corpus_of):
    rules = RuleSet()
    files = prepare.analyzable(corpus_of(*[(f"d/f{s}{e}", f"x\n{line}\ny") for s, e, line in SAMPLES]))
    columns = ("file", "line", "rule_id", "matched")
    with_it = scan.hits(files, rules).select(*columns).collect()
    without = scan.hits(files, rules, prefilter=False).select(*columns).collect()
    assert sorted(with_it) == sorted(without) and with_it


def test_suppression_never_empties_a_line(spark, corpus_of):
    rules = RuleSet()
    files = prepare.analyzable(corpus_of(*[(f"f{s}{e}", line) for s, e, line in SAMPLES]))
    before = {(r.file, r.line) for r in scan.hits(files, rules, suppress=False).select("file", "line").collect()}
    after = {(r.file, r.line) for r in scan.hits(files, rules).select("file", "line").collect()}
    assert before == after


def test_user_rules(spark, corpus_of):
    table = spark.createDataFrame(
        [(100, "Debug Output", "LOW", r"(console\.log~W~*\()", [".js"])], "rule_id int, title string, severity string, regex string, extensions array<string>")
    rules = register_rules(table)
    rows = build_findings(corpus_of(("a.js", "console.log (x)\neval(y)")), rules).orderBy("line").collect()
    assert [(r.title, r.severity, r.weight, r.matched) for r in rows] == [
        ("Debug Output", "LOW", 1, "console.log ("), ("JS/TS Dynamic Evaluation", "HIGH", 5, "eval(")]
    assert list(rows[0].security_story) == ["User Input", "Debug Output", "Potential Impact"]
    assert rows[0].scenario.endswith("creating potential impact.")


def test_user_rules_keep_their_condition(spark):
    given = next(r for r in RULES if r.unless)
    table = spark.createDataFrame([(300, "Own", "LOW", given.regex, [".py"], given.unless)],
                                  "rule_id int, title string, severity string, regex string, extensions array<string>, unless string")
    assert register_rules(table).rules[-1].unless == given.unless


def test_rule_sets_are_checked():
    with pytest.raises(ValueError):
        RuleSet(RULES + (RULES[0],))
    many = tuple(Rule(i, f"t{i}", "LOW", "(a)", (".js",)) for i in range(3000))
    with pytest.raises(ValueError):
        RuleSet(many)


def test_scan_plan_has_no_shuffle(spark, corpus_of):
    plan = build_findings(corpus_of(("a.js", "eval(a)")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_weights(spark):
    from corpusguard.operators.enrich import with_weight
    df = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",)], "severity string")
    assert [r.weight for r in with_weight(df).collect()] == [10, 5, 2, 1]
    assert with_weight(df).agg(F.sum("weight")).first()[0] == 18


def test_stem_words_may_hold_quotes(spark, corpus_of):
    rule = Rule(200, "Quoted", "LOW", r"(it's \\ here)", (".js",), stem="it's \\ h")
    rows = build_findings(corpus_of(("a.js", "x it's \\ here\ny"), ("b.js", "its here")), RuleSet((rule,))).collect()
    assert [(r.file, r.line, r.title) for r in rows] == [("a.js", 1, "Quoted")]


def test_sources_run_behind_their_own_words_and_probes_are_dealt(spark):
    import re

    from pyspark.sql import functions as F

    from corpusguard.operators.enrich import source_label
    from corpusguard.rules import SOURCE_WORDS, SOURCES
    from registry import probes
    hits = ["req.body.a", "req.query.b", "req.params.c", "process.env.D", "request.args['e']", "request.args.get('e')", "request.form[f]",
            "request.json", "$_GET['g']", "$_COOKIE[h]", "Request.Query[i]", "Request.Params[j]", "request.getParameter(k)"]
    odd = ["", "req.body.", "prereq.body.x", "request.argsx", "$_X[1]", "Request.Other[1]", "req.bodyx request.json[0]", None]
    texts = hits + odd + [a + " " + b for a in hits for b in hits[::-1]]
    assert len(SOURCE_WORDS) == len(SOURCES)
    for text in hits:
        assert all(word in text for word, p in zip(SOURCE_WORDS, SOURCES) if re.search(p, text))
    rows = [(i, t, texts[-i]) for i, t in enumerate(texts)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, c string, m string").select("i", source_label(F.col("c"), F.col("m")).alias("s")).collect()}
    for i, c, m in rows:
        found = [x[1] for t in (c, m) for x in (re.search(p, t or "") for p in SOURCES) if x]
        stem = c is not None and any(w in c for w in ("req.", "process.env.", "request.", "$_", "Request."))
        assert got[i] == (found[0] if stem and found else None), (c, m)
    # one row group, which one task would read: its rows are dealt by key
    plan = probes.probes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
