"""Statements by matched brackets, and the structure read from them; expectations worked out by hand."""

import time
from functools import lru_cache

from corpusguard.functions import layout
from corpusguard.functions.layout import statements
from corpusguard.operators import prepare, structure as S


def lines_of(text):
    return [(r.line_no, r.level, r.line.strip()) for r in statements(text)]


def test_a_bundle_is_cut_like_formatted_code():
    bundle = "const a = 1; function after(x) { one(x); class B { m() { two() } } } after(a)"
    formatted = "const a = 1;\nfunction after(x) {\n  one(x);\n  class B {\n    m() {\n      two()\n    }\n  }\n}\nafter(a)\n"
    assert [x[2] for x in lines_of(bundle)] == [x[2] for x in lines_of(formatted)]
    assert [x[1] for x in lines_of(bundle)] == [x[1] for x in lines_of(formatted)]


def test_headers_values_and_lists_stay_whole():
    assert lines_of("import {\n  a, // one\n  b as c\n}\n from './m'\nexport {\n  a,\n  c\n}\n") == [
        (1, 0, "import { a, b as c } from './m'"), (6, 0, "export { a, c }")]
    assert lines_of("const f = (a) =>\n  g(a)\n    .h()\nk()") == [(1, 0, "const f = (a) => g(a) .h()"), (4, 0, "k()")]
    assert lines_of("const {\n  a: { b }\n} = require(\n  'm'\n)")[0][2].startswith("const { a: { b } } = require(")


def test_values_inside_bodies_stay_whole():
    assert [x[2] for x in lines_of("class T {\n  m() {\n    const f = a =>\n      g(a)\n        .h()\n    k()\n  }\n}")] == [
        "class T {", "m() {", "const f = a => g(a) .h()", "k()", "}", "}"]


def test_bodies_inside_values_are_cut():
    assert [x[2] for x in lines_of("const f = xs => xs.map(x => {\n  a(\n    x)\n  function g() {\n    b()\n  }\n})\nconst o = () => ({\n  n: 1,\n  m() {\n    c()\n  },\n})")] == [
        "const f = xs => xs.map(x => {", "a(", "x)", "function g() {", "b()", "}", "})", "const o = () => ({", "m() {", "c()", "},", "})"]


def test_declared_variables_get_their_keyword():
    assert [x[2] for x in lines_of("export const q = 1, r = f(1, 2), { s, t } = u()\nlet a, b = () => 2,\n  c = 3\nd()")] == [
        "export const q = 1,", "export const  r = f(1, 2),", "export const  { s, t } = u()", "let a,", "let  b = () => 2,", "let   c = 3", "d()"]
    assert [x[2] for x in lines_of("const m: Map<string, X> = y(), n = 1; for (let i = 0, j = 1; ;) { }")] == [
        "const m: Map<string, X> = y(),", "const  n = 1; for (let i = 0, j = 1; ;) { }"]


def test_heads_are_flat():
    def head(text):
        return statements(text)[0].head
    assert head("function deep(a = f(g(h(i(j(1))))), {b: {c}}, [d, [e]]) {") == "function deep(a = f, \x01, \x02) {"
    assert head("f(cb: (e: E) => Map<string, Map<a, b>>, s = 'x, y') {") == "f(cb:  \x04 Map, s = '') {"
    assert head("m(@Inject(X) x: T) {") == "m(x: T) {"


def test_strings_templates_and_expressions():
    assert lines_of("a('}'); b(\"{\"); c(`x ${d(`y ${e(1)} z`)} {`)\nf(`{\n(`)\ng(/[\"'{(]/.test(x) / 2 / y)") == [
        (1, 0, "a('}'); b(\"{\"); c((d((e(1)))))"), (2, 0, "f(``)"), (4, 0, "g(''.test(x) / 2 / y)")]
    assert lines_of("/* f(1)\n */ g() // h()\nlet x = `never closed ( {\nk()")[0] == (2, 0, "g()")


def test_broken_text_stays_bounded():
    for text in ("(" * 50000, "{" * 50000, "}" * 50000 + "function f() { a() }", ")}]" * 20000, "`" * 9999, "'" * 9999, "a => " * 20000,
                 "const x = [" + "{a: 1}, " * 30000 + "]", "f(" * 20000 + ")" * 20000, "function f(){" * 8000 + "}" * 8000, "a: b, " * 60000 + "{",
                 "const f = a => " * 20000, "f(a => { " * 5000 + "})" * 5000, "word " * 90000 + "{ x }", "`${" * 3000 + "}`" * 3000):
        started = time.time()
        statements(text)
        assert time.time() - started < 20, text[:20]
    assert lines_of("") == [] and lines_of(None) == []


def structure_of(corpus_of, text, file="a.ts"):
    facts = S.line_facts(prepare.analyzable(corpus_of((file, text))))
    events = S.scoped(facts).cache()
    return facts, events, sorted((r.caller, r.callee) for r in S.call_edges(events).collect())


def test_methods_with_any_header(corpus_of):
    _, events, edges = structure_of(corpus_of, """class A {
  one(
    a = f(),
    cb: () => void,
    @Inject(X) x: { n: number; s: string },
    s = ';'
  ): Promise<Map<string, X>> {
    first()
  }
  @dec('a') two(b = g(h(i(j(k(1)))))) { second() }
  get three(): { value: number } { return third() }
}
""")
    assert sorted((r.name, r.line_no, list(r.params)) for r in S.method_rows(events).collect()) == [
        ("A.one", 2, ["a", "cb", "x", "s"]), ("A.three", 11, []), ("A.two", 10, ["b"])]
    assert {e for e in edges if e[1] in ("first", "second", "third", "one", "two")} == {("A.one", "first"), ("A.two", "second"), ("A.three", "third")}


def test_two_functions_on_a_line_keep_their_calls(corpus_of):
    _, events, edges = structure_of(corpus_of, "const a = 1; function f() { one() } function g() { two(); const h = () => three(); four() } five()\n")
    assert edges == [("f", "one"), ("g", "four"), ("g", "two"), ("h", "three"), ("root", "five")]
    assert sorted(r.name for r in S.function_rows(events).collect()) == ["f", "g", "h"]


def test_scopes_close_in_callbacks_and_blocks(corpus_of):
    _, _, edges = structure_of(corpus_of, """function outer() {
  if (a()) { function inner() { b() } inner() } else { c() }
  items.forEach(function (x) { d(x); items.map(y => { e(y) }) })
  const o = { m() { g() }, n: 1 }
  f()
}
class K { run() { class L { go() { h() } } i() } }
j()
""")
    assert edges == [("K.run", "i"), ("L.go", "h"), ("inner", "b"), ("m", "g"), ("outer", "a"), ("outer", "c"), ("outer", "d"), ("outer", "e"),
                     ("outer", "f"), ("outer", "forEach"), ("outer", "inner"), ("outer", "map"), ("root", "j")]


def test_exports_and_requires_of_any_depth(corpus_of):
    facts, _, _ = structure_of(corpus_of, """export const q = 1, r = 2
const { a: { b: { c } }, d: e } = require('m'), x = require("n")
""")
    assert [(r.name, r.line_no) for r in S.exports(facts, "detail").orderBy("place").collect()] == [("q", 1), ("r", 1)]
    assert [(r.source, list(r.specifiers), [tuple(b) for b in r.bindings]) for r in S.requires(facts).orderBy("place").collect()] == [
        ("m", ["a", "d"], [("d", "e")]), ("n", ["x"], [("default", "x")])]


def test_prose_is_few_tokens_and_changes_no_row():
    words = "alpha beta, gamma delta and of. Epsilon é zeta 12 for with this as is in - it ".split()
    prose = " ".join(words[(i * i + i // 7) % len(words)] for i in range(400))
    code = "const a = 1, b = (x) =>\n  {0}\nclass A {{\n m(a) {{ {0} }}\n}}\nimport {{ x }} from 'y'\nf(`t ${{ g({0}) }}`)\n"
    few = layout._Text(f"{prose}\n{prose}, new\nfoo(1)\n{prose}\n{prose}\n{prose}\n")
    assert len(few.kind) < 80 and "".join(few.text).startswith(prose)
    texts = [prose, code.format(prose), code.format("y") + (prose + "\n") * 9, f"const x = {{ k() {{ }},\n{prose},\n z }}\n{prose}",
             f"let q,\n{prose}\n{prose}\n = 2\nimport\n{prose}\n{prose}\n{prose}", f"function\n{prose}\n{prose}\n{prose}\n(a) {{ }}",
             f"`open ${{ {prose}\n\n{prose}\n{prose}", f"const f = () =>\n\n{prose}.\n{prose}\n{prose}\n"]
    for text in texts:
        plain = list(layout._Layout(text, prose=False).rows())
        got = layout.statements(text)
        assert [r._replace(place=0) for r in got] == [r._replace(place=0) for r in plain]
        assert [r.place for r in got] == sorted(r.place for r in got)


def test_scopes_are_told_without_shuffle_or_sort(corpus_of):
    text = ("class A extends B {\n  async\u00a0m(a) {\n    f()\n    const g = (x) => {\n      h()\n    }\n    class C { n() { i() } }\n    j()\n  }\n  k = l()\n}\n"
            "const o = function named(p) {\n  q()\n  if (r) { s() } else { t() }\n}\nu()\n")
    facts = S.line_facts(prepare.analyzable(corpus_of(("a.ts", text), ("b.ts", "v()\n}\nfunction w() { x() }"))))
    events = S.scoped(facts)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    got = {c: (r.class_name, r.caller) for r in events.collect() for c in r.calls or []}
    assert got == {
        "f": ("A", "A.m"), "h": ("A", "g"), "i": ("C", "C.n"), "j": ("A", "A.m"), "l": ("A", "root"), "q": (None, "o"), "s": (None, "o"),
        "t": (None, "o"), "u": (None, "root"), "v": (None, "root"), "x": (None, "w")}


def test_plain_lines_are_the_same_tokens():
    code = "\t const a = 'x/y`z', é = \"it's\" ;f( g ) => [1 .2]\u2003b\r\n  don't say 'so\n@D.e({ k: v })<T>\n// c 'd\n  x = /'[/]/g.test(y) // z\n`t ${u}\n` w\n"
    plain, at_once = layout._plain_line, layout._Text(code * 2, prose=False)
    try:
        layout._plain_line = lru_cache(lambda line: None)
        slow = layout._Text(code * 2, prose=False)
    finally:
        layout._plain_line = plain
    assert (at_once.kind, at_once.text, at_once.line, at_once.inner) == (slow.kind, slow.text, slow.line, slow.inner)
