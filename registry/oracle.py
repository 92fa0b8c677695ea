"""SQL equivalents of the registered queries, for the embedded checker database.

Each query is a list of named common table expressions and a final select. The
patterns and texts are the fixed values of the rule module; everything
relational is written here on its own.
"""

from __future__ import annotations

from corpusguard.operators import aggregate as A, payload as P
from corpusguard.operators.graph import COLUMN_WIDTH, EDGE_CAP, NODE_CAP, ROW_HEIGHT
from corpusguard.operators.resolve import IMPORT_SUFFIXES
from corpusguard.operators.roles import ENTRY_HINT
from corpusguard.rules import (
    ALLOWED_EXTENSIONS, API, AUTH, COMMENT_MARKERS, DATA, DEFAULT_SOURCE, ENTRY_LADDER, FRAMEWORKS, FUNCTION_HEADER, GENERAL,
    IGNORED_SEGMENTS, JS, LB, RB, RESPONSIBILITIES, RULES, SERVICE, SEVERITY_WEIGHTS, SINK, SOURCES, STATUS_EXTENSIONS, UI,
    W, RuleSet, SCENARIOS,
)
from corpusguard.sources import readers
from registry import line_patterns as L, probes
from registry.corpora import SLOTS, WORKED, code_corpus_sql, line_corpus_sql, q

ORACLE: dict[str, str] = {}
KEY = "repo, file, seq"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{W}+|{W}+' + chr(92) + 'z')}, '', 'g')"


def plain(pattern: str) -> str:
    """The pattern without possessive loops, which this dialect lacks and does not need."""
    return pattern.replace("*+", "*").replace("++", "+")


def hits(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(plain(pattern))})"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(plain(pattern))}, {group})"


BREAKS = f"regexp_replace(p, {q('[^' + chr(10) + ']+')}, '', 'g')"
BODY = f"regexp_replace(p, {q(chr(92) + 'r?' + chr(92) + 'n' + chr(92) + 'z')}, '')"


def statements(content: str) -> str:
    """Comments and template texts out, headers of several lines on one."""
    inside = f"regexp_replace(array_to_string(regexp_extract_all(p, {q(plain(L.EXPRESSION))}, 1), ' + '), {q(chr(92) + 's+')}, ' ', 'g')"
    code = f"""array_to_string(list_transform(regexp_extract_all({content}, {q(plain(L.PIECE))}), lambda p: CASE WHEN starts_with(p, '//') THEN ''
      WHEN starts_with(p, '/*') THEN ' ' || {BREAKS} WHEN starts_with(p, '`') AND contains(p, '${{') THEN '(' || {inside} || ')' || {BREAKS}
      WHEN starts_with(p, '`') AND contains(p, chr(10)) THEN '``' || {BREAKS} ELSE p END), '')"""
    return f"""array_to_string(list_transform(regexp_extract_all({code}, {q(plain(L.STATEMENT))}), lambda p: CASE WHEN contains({BODY}, chr(10))
      THEN regexp_replace({BODY}, {q(chr(92) + 's*' + chr(92) + 'n' + chr(92) + 's*')}, ' ', 'g') || {BREAKS} ELSE p END), '')"""


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def word(x: str, *words: str) -> str:
    return hits(x, LB + "(?:" + "|".join(words) + ")" + RB)


def joined(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, {q(sep)}), '')"


def fold(path: str) -> str:
    """Path segments folded one by one."""
    return f"""array_to_string(list_reduce(list_transform(string_split(replace({path}, '\\', '/'), '/'), lambda p: [p]),
      lambda acc, p: CASE WHEN p[1] IN ('', '.') THEN acc WHEN p[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, p) END,
      CAST([] AS VARCHAR[])), '/')"""


def parent(path: str) -> str:
    return f"array_to_string(string_split(replace({path}, '\\', '/'), '/')[:-2], '/')"


RULE_ROWS = ", ".join(
    f"({r.rule_id}, {i}, {q(r.title)}, {q(r.severity)}, {SEVERITY_WEIGHTS[r.severity]}, {array(r.story)}, {q(SCENARIOS[r.scenario])}, "
    f"{q(r.why)}, {q(r.impact)}, {q(r.fix)})" for i, r in enumerate(RULES, start=1))
RULE_EXT_ROWS = ", ".join(f"({q(e)}, {r.rule_id})" for r in RULES for e in r.extensions)


def hit_selects() -> str:
    parts = []
    for r in RULES:
        extra = ""
        if r.unless_pattern:
            extra = (f" AND len(regexp_extract_all(line, {q(r.pattern)})) > len(regexp_extract_all(line, {q(r.unless_pattern)}))")
        parts.append(f"SELECT {KEY}, file_type, line_no, line, {r.rule_id} AS rule_id, {trim(ext('line', r.pattern))} AS matched "
                     f"FROM active WHERE file_type IN {in_list(r.extensions)} AND {hits('line', r.pattern)}{extra}")
    return " UNION ALL ".join(parts)


def source_case(context: str, matched: str) -> str:
    whens = " ".join(f"WHEN {hits(c, p)} THEN {ext(c, p)}" for c in (context, matched) for p in SOURCES)
    return f"CASE {whens} END"


def entry_case(source: str) -> str:
    return "CASE " + f"WHEN {source} IS NULL THEN 'User Input' " + " ".join(
        f"WHEN {hits(source, '(?i)' + p)} THEN {q(e)}" for p, e, _ in ENTRY_LADDER) + " ELSE 'User Input' END"


def evidence_case(source: str) -> str:
    return "CASE " + " ".join(f"WHEN {hits(source, '(?i)' + p)} THEN {q(v)}" for p, _, v in ENTRY_LADDER) + f" ELSE {source} END"


def sink(matched: str) -> str:
    return f"nullif({ext(matched, SINK)}, '')"


def level_case(title: str, source: str, context: str) -> str:
    return (f"CASE WHEN {source} IS NOT NULL THEN 'High' WHEN {hits(context, FUNCTION_HEADER)} THEN 'Medium' "
            f"WHEN {title} = 'Hardcoded Secret' OR contains({title}, 'Insecure Deserialization') OR contains({title}, 'Local File Inclusion') "
            f"THEN 'Medium' ELSE 'Low' END")


def scenario_text(template: str, story: str, source: str) -> str:
    return (f"replace(replace(replace({template}, '{{sink}}', {story}[2]), '{{outcome}}', lower({story}[3])), '{{src}}', "
            f"coalesce({source}, {q(DEFAULT_SOURCE)}))")


def story_text(story: str, source: str) -> str:
    return f"coalesce({source}, {story}[1]) || '|' || {story}[2] || '|' || {story}[3]"


def file_type(path: str) -> str:
    return f"CASE WHEN contains({path}, '.') THEN lower({ext(path, r'(\.[^.]*)' + chr(92) + 'z')}) ELSE 'unknown' END"


NOT_BLANK = r"[^\t-\r\p{Z}\x{FEFF}]"
SEGMENTS = "string_split(replace(lower(file), '\\', '/'), '/')"

CTE = {
    "line_corpus": line_corpus_sql(),
    "code_corpus": code_corpus_sql(),
    "probes": probes.probes_sql(),
    "urls": probes.urls_sql(),
    "files": f"""files AS MATERIALIZED (SELECT *, {file_type('file')} AS file_type FROM corpus
      WHERE file IS NOT NULL AND content IS NOT NULL AND {hits('file', NOT_BLANK)} AND {file_type('file')} IN {in_list(ALLOWED_EXTENSIONS)}
      AND NOT list_has_any({SEGMENTS}, {array(IGNORED_SEGMENTS)}))""",
    "lines": f"""lines AS MATERIALIZED (SELECT {KEY}, file_type, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line
      FROM (SELECT *, string_split_regex(content, {q(chr(92) + 'r?' + chr(92) + 'n')}) AS ls FROM files))""",
    "active": f"""active AS MATERIALIZED (SELECT * FROM lines WHERE NOT contains(line, 'scan-ignore')
      AND NOT {hits('line', f'^{W}*(?:' + '|'.join(m.replace('/', '/').replace('*', chr(92) + '*').replace('{', chr(92) + '{') for m in COMMENT_MARKERS) + ')')})""",
    "context": """context AS MATERIALIZED (SELECT repo, file, seq, line_no, string_agg(line, chr(10)) OVER (PARTITION BY repo, file, seq
      ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM lines)""",
    "rules": f"rules(rule_id, rule_ord, title, severity, weight, story, template, why, impact, fix) AS (VALUES {RULE_ROWS})",
    "rule_ext": f"rule_ext(file_type, rule_id) AS (VALUES {RULE_EXT_ROWS})",
    "raw_hits": f"raw_hits AS MATERIALIZED ({hit_selects()})",
    "hits": """hits AS MATERIALIZED (SELECT h.* FROM raw_hits h JOIN rules r USING (rule_id) WHERE NOT (r.title IN ('JS/TS Command Injection', 'Python Command Injection')
      AND EXISTS (SELECT 1 FROM raw_hits o JOIN rules x USING (rule_id) WHERE o.repo = h.repo AND o.file = h.file AND o.seq = h.seq
        AND o.line_no = h.line_no AND contains(x.title, 'Command Injection ('))))""",
    "findings": f"""findings AS MATERIALIZED (SELECT h.repo, h.file, h.seq, h.file_type, h.line_no AS line, r.rule_ord, r.severity, r.weight, r.title, h.matched,
      h.file || ':' || h.line_no || ':' || r.title || ':' || h.matched AS id,
      CASE WHEN length({trim('h.line')}) > 120 THEN substr({trim('h.line')}, 1, 120) || '... [truncated]' ELSE {trim('h.line')} END AS code,
      c.context, {source_case('c.context', 'h.matched')} AS source, r.story, r.template
      FROM hits h JOIN rules r USING (rule_id) JOIN context c ON c.repo = h.repo AND c.file = h.file AND c.seq = h.seq AND c.line_no = h.line_no)""",
}
LINE = ["line_corpus", "files", "lines"]
CODE = ["code_corpus", "files", "lines"]
FIND = ["active", "context", "rules", "raw_hits", "hits", "findings"]


def add(name: str, ctes: list[str], select: str, recursive: bool = False) -> None:
    used = [CTE[c] for c in ctes]
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in used) + "\n" if used else ""
    ORACLE[name] = head + select


# --- sources --------------------------------------------------------------------
add("src_corpus", ["line_corpus"], "SELECT repo, file, seq, md5(content) AS content_md5 FROM corpus")
add("src_tree", ["line_corpus"], "SELECT repo, seq, file AS path FROM corpus WHERE seq % 9 <> 4 AND seq % 11 <> 3")
add("src_decode", [], f"""SELECT doc_id, CASE WHEN ok THEN text END AS content, CASE WHEN NOT ok THEN {q(readers.NOT_DECODABLE)} END AS error
  FROM (SELECT *, doc_id % 13 <> 5 AND doc_id % 7 <> 2 AND doc_id % 17 <> 8 AS ok FROM documents)""")
SEGS = f"""segs AS (SELECT *, string_split(regexp_replace(regexp_replace({ext('trimmed', r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)')}, '^/', ''), {q(chr(92) + '.git' + chr(92) + 'z')}, ''), '/') AS parts,
  lower({ext('trimmed', r'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)')}) AS host FROM (SELECT *, {trim('url')} AS trimmed FROM urls))"""
CTE["segs"] = SEGS
GOOD_URL = "(host IN ('github.com', 'www.github.com') AND len(parts) >= 2)"
add("src_repo_url", ["urls", "segs"], f"""SELECT page_id, CASE WHEN {GOOD_URL} THEN parts[1] END AS owner,
  CASE WHEN {GOOD_URL} THEN parts[2] END AS repo_name FROM segs""")
BLANK_URL = f"(url IS NULL OR NOT {hits('url', NOT_BLANK)})"
add("src_validate", ["urls", "segs"], f"""SELECT page_id, CASE WHEN {BLANK_URL} THEN {q(readers.NO_URL)}
  WHEN path IS NULL OR NOT {hits('path', NOT_BLANK)} THEN {q(readers.NO_PATH)} WHEN NOT {GOOD_URL} THEN {q(readers.BAD_URL)} ELSE '' END AS reason FROM segs""")
add("src_validate_payload", ["urls"], f"""SELECT page_id, 'insight' AS kind, reason IS NULL AS ok, reason FROM (SELECT page_id, CASE WHEN {BLANK_URL} THEN {q(readers.NO_SOURCE_URL)}
    WHEN page_id % 4 IN (1, 3) THEN {q(readers.NO_ANALYSIS)} END AS reason FROM urls)
  UNION ALL SELECT page_id, 'explain', reason IS NULL, reason FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 OR coalesce(url, '') = '' OR page_id % 6 = 0
    THEN {q(readers.NO_EXPLAIN)} END AS reason FROM urls)""")
add("src_default_path", [], """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.js' WHEN 2 THEN 'b.ts' ELSE 'pasted-file.js' END AS path, doc_id % 6 <> 5 AS ok FROM documents""")
add("snk_results", LINE + FIND, "SELECT repo, id, seq, CAST(line AS BIGINT) AS line, severity FROM findings")

# --- filters and projections -------------------------------------------------------
add("flt_blank", [], """SELECT doc_id AS seq, 'f' || doc_id AS file, CAST(CASE WHEN doc_id % 5 = 1 THEN 0 ELSE length(text) END AS BIGINT) AS n_chars
  FROM documents WHERE doc_id % 7 > 1 AND doc_id % 5 <> 0""")
add("prj_file_type", [], f"""SELECT seq, file, {file_type('file')} AS file_type FROM (SELECT doc_id AS seq,
  source || '/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.JS' WHEN 1 THEN '' WHEN 2 THEN '.d.Ts' ELSE '.x/y' END AS file FROM documents)""")
add("flt_extension", ["code_corpus"], f"SELECT repo, file, seq FROM corpus WHERE {file_type('file')} IN {in_list(ALLOWED_EXTENSIONS)}")
add("flt_ignored_path", ["line_corpus"], f"SELECT repo, file, seq FROM corpus WHERE NOT list_has_any({SEGMENTS}, {array(IGNORED_SEGMENTS)})")
add("prj_lines", LINE, "SELECT repo, file, line_no, md5(line) AS line_md5 FROM lines")
add("prj_loc", LINE, f"SELECT repo, file, count(*) FILTER ({hits('line', NOT_BLANK)}) AS loc FROM lines GROUP BY ALL")
add("flt_suppressed", LINE, "SELECT repo, file, line_no FROM lines WHERE line NOT LIKE '%scan-ignore%'")
add("flt_comment", LINE, "SELECT repo, file, line_no FROM (SELECT *, " + f"regexp_replace(line, {q(f'^{W}+')}, '')" + " AS t FROM lines) WHERE NOT ("
    + " OR ".join(f"starts_with(t, {q(m)})" for m in COMMENT_MARKERS) + ")")
add("prj_snippet", LINE, f"""SELECT repo, file, line_no, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '... [truncated]' ELSE t END AS code
  FROM (SELECT *, {trim('line')} AS t FROM lines)""")
add("prj_context", LINE + ["context"], "SELECT repo, file, line_no, md5(context) AS context_md5 FROM context")

# --- scan ------------------------------------------------------------------------------
add("scn_route", LINE + ["rules", "rule_ext"], """SELECT repo, file, CAST(rule_id AS BIGINT) AS rule_id, CAST(rule_ord AS BIGINT) AS rule_ord
  FROM files JOIN rule_ext USING (file_type) JOIN rules USING (rule_id)""")
add("scn_rules", LINE + ["active", "raw_hits"], "SELECT repo, file, line_no AS line, CAST(rule_id AS BIGINT) AS rule_id, matched FROM raw_hits")
add("scn_secret", [], f"""SELECT doc_id, line_no, {trim(ext('line', RULES[0].pattern))} AS matched,
  CASE WHEN length({trim('line')}) > 120 THEN substr({trim('line')}, 1, 120) || '... [truncated]' ELSE {trim('line')} END AS code
  FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM
    (SELECT doc_id, string_split_regex(text, {q(chr(92) + 'r?' + chr(92) + 'n')}) AS ls FROM documents))
  WHERE {hits('line', RULES[0].pattern)} AND NOT contains(line, 'scan-ignore')
    AND NOT list_contains(list_transform({array(COMMENT_MARKERS)}, lambda m: starts_with({trim('line')}, m)), true)""")
add("scn_suppress", LINE + ["active", "rules", "raw_hits", "hits"], "SELECT repo, file, line_no AS line, CAST(rule_id AS BIGINT) AS rule_id, matched FROM hits")
add("scn_finding_id", LINE + FIND, "SELECT repo, seq, id FROM findings")
add("scn_order", LINE + FIND, "SELECT repo, seq, CAST(line AS BIGINT) AS line, CAST(rule_ord AS BIGINT) AS rule_ord, id FROM findings ORDER BY repo, seq, line, rule_ord")
add("scn_findings", LINE + FIND, f"""SELECT repo, file, seq, id, CAST(line AS BIGINT) AS line, CAST(rule_ord AS BIGINT) AS rule_ord, severity, title, matched, code,
  md5(context) AS context_md5, {story_text('story', 'source')} AS security_story, {level_case('title', 'source', 'context')} AS story_confidence,
  {scenario_text('template', 'story', 'source')} AS scenario, {entry_case('source')} AS chain_entry, {evidence_case('source')} AS chain_entry_evidence,
  story[2] AS chain_sink, {sink('matched')} AS chain_sink_evidence, story[3] AS chain_impact, file || ':' || line AS chain_location FROM findings""")

# --- enrichment -------------------------------------------------------------------------
PROBE_RULES = ["probes", "rules"]
add("enr_source", ["probes"], f"SELECT doc_id, {source_case('context', 'matched')} AS source FROM probes")
add("enr_entry", ["probes"], f"SELECT doc_id, {entry_case('source')} AS entry, {evidence_case('source')} AS evidence FROM probes")
add("enr_sink", ["probes"], f"SELECT doc_id, {sink('matched')} AS sink_evidence FROM probes")
add("enr_confidence", ["probes"], f"SELECT doc_id, {level_case('title', 's', 'context')} AS level FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN source END AS s FROM probes)")
add("enr_story", PROBE_RULES, f"SELECT doc_id, {story_text('story', 'source')} AS story FROM probes JOIN rules USING (title)")
add("enr_scenario", PROBE_RULES, f"SELECT doc_id, {scenario_text('template', 'story', 'source')} AS scenario FROM probes JOIN rules USING (title)")
add("enr_chain", PROBE_RULES, f"""SELECT doc_id, {entry_case('source')} AS entry, {evidence_case('source')} AS entry_evidence, story[2] AS sink,
  {sink('matched')} AS sink_evidence, story[3] AS impact, title || ':' || doc_id AS location FROM probes JOIN rules USING (title)""")
add("enr_explain", PROBE_RULES, "SELECT doc_id, title, why, impact, fix FROM probes LEFT JOIN rules USING (title)")
add("enr_weight", [], """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CAST(CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM documents""")

# --- structure ------------------------------------------------------------------------------
BIND = 'STRUCT(imported VARCHAR, "local" VARCHAR)[]'
NO_TEXTS, NO_BINDINGS = "CAST([] AS VARCHAR[])", f"CAST([] AS {BIND})"


QUOTED = plain(L.QUOTED)


def items(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda p: {trim('p')}), lambda p: p <> '')"


def named(x: str) -> str:
    good = f"list_filter({items(x)}, lambda p: {hits('p', L.NAMED_ITEM)})"
    return (f"list_transform({good}, lambda p: {{'imported': {ext('p', L.NAMED_ITEM, 1)}, "
            f"'local': coalesce(nullif({ext('p', L.NAMED_ITEM, 2)}, ''), {ext('p', L.NAMED_ITEM, 1)})}})")


def params(x: str) -> str:
    flat = f"regexp_replace({x}, {q(QUOTED)}, {q(chr(39) * 2)}, 'g')"
    for _ in range(6):  # the innermost brackets of each kind, as deep as the corpora go
        for pattern, mark in ((r"\{[^{}()\[\]]*\}", "chr(1)"), (r"\[[^{}()\[\]]*\]", "chr(2)"), (r"\([^{}()\[\]]*\)", "''")):
            flat = f"regexp_replace({flat}, {q(pattern)}, {mark}, 'g')"
    flat = f"regexp_replace({flat}, {q('<[^<>]*>')}, '', 'g')"
    name = (f"CASE WHEN {hits('p', L.PARAM_NAME)} THEN {ext('p', L.PARAM_NAME)} WHEN {hits('p', L.PARAM_REST)} THEN '...' || {ext('p', L.PARAM_REST, 2)} "
            f"WHEN starts_with(p, chr(1)) AND NOT contains(p, '=') THEN '{{...}}' WHEN starts_with(p, chr(2)) AND NOT contains(p, '=') THEN '[...]' ELSE '' END")
    return f"list_filter(list_transform({items(flat)}, lambda p: {name}), lambda p: p <> '')"


def value(x) -> str:
    """A worked-out value as SQL; texts name their run."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(value(v) for v in x) + "]"
    return str(x) if isinstance(x, int) else q(x)


def worked(kind: str, *columns: str) -> str:
    """The rows of the files that were read by hand, joined to each such file; a statement's place is a part of its line."""
    def cell(x) -> str:
        if isinstance(x, list) and x and isinstance(x[0], tuple):
            return "[" + ", ".join(f"{{'imported': {value(i)}, 'local': {value(b)}}}" for i, b in x) + "]"
        return value(x)
    rows = ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in WORKED[kind])
    return (f"(SELECT f.repo, f.file, f.seq, CAST(f.seq - f.seq % {SLOTS} AS VARCHAR) AS m, w.line + w.sub / 1000.0 AS line_no, w.* EXCLUDE (slot, line, sub) "
            f"FROM files f JOIN (VALUES {rows}) w(slot, line, sub, {', '.join(columns)}) ON f.file LIKE 'worked/%' AND w.slot = f.seq % {SLOTS})")


def of_run(x: str) -> str:
    return f"replace({x}, '{{m}}', m)"


LINE_NO = "CAST(floor(line_no) AS BIGINT)"
FN_EXPORTED = f"({hits('line', L.DECLARATION)} AND {ext('line', L.DECLARATION, 1)} <> '')"
CLASS_NAME = f"CASE WHEN {hits('line', L.CLASS)} AND {ext('line', L.CLASS, 3)} NOT IN {in_list(L.NOT_A_NAME)} THEN {ext('line', L.CLASS, 3)} END"
CLASS_EXPORTED = f"({CLASS_NAME} IS NOT NULL AND {ext('line', L.CLASS, 1)} <> '')"
# the same without possessive loops and look-behind, which this dialect lacks
CALL = rf"({L.I}){W}*\("
CALLED = (f"regexp_replace(regexp_replace(line, {q(QUOTED)}, '''''', 'g'), {q(L.LINE_COMMENT)}, '', 'g')")
ENDPOINT = " || ".join(ext("line", L.FILE_CALL, g) for g in (1, 2, 3))

CTE.update({
    "js": f"""js AS MATERIALIZED (SELECT {KEY}, file_type, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line
      FROM (SELECT *, string_split_regex({statements('content')}, {q(chr(92) + 'r?' + chr(92) + 'n')}) AS ls FROM files WHERE file_type IN {in_list(JS)} AND file NOT LIKE 'worked/%'))""",
    "imports": f"""import_parts AS (SELECT *, nullif({ext('clause', L.CLAUSE_DEFAULT)}, '') AS d, nullif({ext('clause', L.CLAUSE_NAMESPACE)}, '') AS ns,
        {named(ext('clause', L.CLAUSE_NAMED))} AS names
      FROM (SELECT *, regexp_replace({trim(ext('line', L.IMPORT_FROM, 1))}, {q(L.CLAUSE_TYPE)}, '') AS clause,
        {ext('line', L.IMPORT_FROM, 2)} || {ext('line', L.IMPORT_FROM, 3)} AS source FROM js WHERE {hits('line', L.IMPORT_FROM)})),
    require_parts AS (SELECT *, starts_with(target, '{{') AS is_pattern,
        list_filter({items("regexp_replace(trim(target, '{}'), " + q('{[^{}]*}') + ", chr(1), 'g')")}, lambda p: {hits('p', L.REQUIRE_ITEM)}) AS props
      FROM (SELECT *, {ext('line', L.REQUIRE, 1)} AS target, {ext('line', L.REQUIRE, 2)} || {ext('line', L.REQUIRE, 3)} AS source FROM js WHERE {hits('line', L.REQUIRE)})),
    imports AS MATERIALIZED (
      SELECT {KEY}, line_no, 'import' AS kind, source, coalesce(ns, d, names[1]."local") AS alias,
        CASE WHEN ns IS NOT NULL THEN 'namespace' WHEN d IS NOT NULL THEN 'default' WHEN len(names) > 0 THEN 'named' ELSE 'side-effect' END AS type,
        list_concat(CASE WHEN d IS NULL THEN {NO_TEXTS} ELSE [d] END, CASE WHEN ns IS NULL THEN {NO_TEXTS} ELSE ['*'] END, list_transform(names, lambda n: n.imported)) AS specifiers,
        list_concat(CASE WHEN d IS NULL THEN {NO_BINDINGS} ELSE [{{'imported': 'default', 'local': d}}] END,
          CASE WHEN ns IS NULL THEN {NO_BINDINGS} ELSE [{{'imported': '*', 'local': ns}}] END, names) AS bindings FROM import_parts
      UNION ALL SELECT {KEY}, line_no, 'import', {ext('line', L.IMPORT_ONLY, 1)} || {ext('line', L.IMPORT_ONLY, 2)}, NULL, 'side-effect', {NO_TEXTS}, {NO_BINDINGS}
        FROM js WHERE {hits('line', L.IMPORT_ONLY)} AND NOT {hits('line', L.IMPORT_FROM)}
      UNION ALL SELECT {KEY}, line_no, 'require', source, CASE WHEN NOT is_pattern THEN target END, 'require',
        CASE WHEN is_pattern THEN list_transform(props, lambda p: {ext('p', L.REQUIRE_ITEM)}) ELSE [target] END,
        CASE WHEN is_pattern THEN list_filter(list_transform(props, lambda p: {{'imported': {ext('p', L.REQUIRE_ITEM)}, 'local':
          CASE WHEN NOT contains(p, ':') AND NOT contains(p, '=') THEN {ext('p', L.REQUIRE_ITEM)} ELSE nullif({ext('p', L.REQUIRE_ITEM, 2)}, '') END}}), lambda b: b."local" IS NOT NULL)
        ELSE [{{'imported': 'default', 'local': target}}] END FROM require_parts
      UNION ALL SELECT {KEY}, line_no, kind, {of_run('source')}, {of_run('alias')}, type, list_transform(specifiers, lambda x: {of_run('x')}),
        CAST(list_transform(bindings, lambda b: {{'imported': {of_run('b.imported')}, 'local': b."local"}}) AS {BIND})
        FROM {worked('imports', 'kind', 'source', 'alias', 'type', 'specifiers', 'bindings')})""",
    "exports": f"""export_rows AS (
      SELECT {KEY}, line_no, 0 AS pos, {ext('line', L.DECLARATION, 4)} AS name, CASE WHEN {ext('line', L.DECLARATION, 2)} <> '' THEN 'default' ELSE 'named' END AS type,
        CAST(NULL AS VARCHAR) AS alias, ['summary', 'detail'] AS vs FROM js WHERE {FN_EXPORTED}
      UNION ALL SELECT {KEY}, line_no, 0, {CLASS_NAME}, CASE WHEN {ext('line', L.CLASS, 2)} <> '' THEN 'default' ELSE 'named' END, NULL, ['summary', 'detail'] FROM js WHERE {CLASS_EXPORTED}
      UNION ALL SELECT {KEY}, line_no, 0, CASE WHEN ok THEN n ELSE 'default' END, 'default', NULL, CASE WHEN ok THEN ['summary', 'detail'] ELSE ['summary'] END
        FROM (SELECT *, n <> '' AND n NOT IN {in_list(L.NOT_A_NAME)} AS ok FROM (SELECT *, {ext('line', L.EXPORT_DEFAULT_NAME)} AS n FROM js
          WHERE {hits('line', L.EXPORT_DEFAULT)} AND NOT {FN_EXPORTED} AND NOT {CLASS_EXPORTED}))
      UNION ALL SELECT {KEY}, line_no, 0, {ext('line', L.EXPORT_VARIABLE)}, 'named', NULL, ['detail'] FROM js WHERE {hits('line', L.EXPORT_VARIABLE)}
      UNION ALL SELECT {KEY}, line_no, i - 1, n[i]."local", 'named', n[i].imported, ['summary', 'detail'] FROM (SELECT *, unnest(generate_series(1, len(n))) AS i
          FROM (SELECT *, {named(ext('line', L.EXPORT_LIST))} AS n FROM js WHERE {hits('line', L.EXPORT_LIST)}))
      UNION ALL SELECT {KEY}, line_no, 0, {ext('line', L.EXPORT_NAMESPACE)}, 'named', NULL, ['summary', 'detail'] FROM js WHERE {hits('line', L.EXPORT_NAMESPACE)}
      UNION ALL SELECT {KEY}, line_no, 0, name, type, alias, vs FROM {worked('exports', 'name', 'type', 'alias', 'vs')}),
    exports AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (vs), unnest(vs) AS variant FROM export_rows)
      QUALIFY variant = 'summary' OR row_number() OVER (PARTITION BY {KEY}, line_no, name, variant ORDER BY pos) = 1)""",
    "scoped": f"""counted AS (SELECT *, regexp_replace(line, {q(QUOTED)}, '', 'g') AS bare FROM js),
    summed AS (SELECT *, sum(len(bare) - len(replace(bare, '{{', '')) - len(bare) + len(replace(bare, '}}', ''))) OVER (PARTITION BY {KEY} ORDER BY line_no) AS level FROM counted),
    lifted AS (SELECT *, level - least(0, min(level) OVER (PARTITION BY {KEY} ORDER BY line_no)) AS after FROM summed),
    levels AS (SELECT *, greatest(0, coalesce(lag(after) OVER (PARTITION BY {KEY} ORDER BY line_no), 0)
        - (len(string_split(bare, '{{')[1]) - len(replace(string_split(bare, '{{')[1], '}}', '')))) AS lowest FROM lifted),
    headers AS MATERIALIZED (SELECT *, {hits('line', L.OPENS)} AS opens, {CLASS_NAME} AS cls,
        CASE WHEN {hits('line', L.DECLARATION)} THEN 'declaration' WHEN {hits('line', L.ARROW)} THEN 'arrow' WHEN {hits('line', L.FUNCTION_VALUE)} THEN 'value' END AS fn_kind,
        CASE WHEN {hits('line', L.METHOD)} AND {ext('line', L.METHOD, 2)} NOT IN {in_list(L.NOT_A_METHOD)} THEN {ext('line', L.METHOD, 2)} END AS method FROM levels),
    named_headers AS MATERIALIZED (SELECT *, CASE fn_kind WHEN 'declaration' THEN {ext('line', L.DECLARATION, 4)} WHEN 'arrow' THEN {ext('line', L.ARROW, 2)}
        WHEN 'value' THEN {ext('line', L.FUNCTION_VALUE, 2)} END AS fn FROM headers),
    bodies AS MATERIALIZED (SELECT h.repo, h.file, h.seq, h.line_no AS first, h.after AS level, coalesce(h.fn, h.method, h.cls) AS name,
        CASE WHEN h.fn IS NOT NULL THEN 'f' WHEN h.method IS NOT NULL THEN 'm' ELSE 'c' END AS sort, min(e.line_no) AS past
      FROM named_headers h LEFT JOIN levels e ON e.repo = h.repo AND e.file = h.file AND e.seq = h.seq AND e.line_no > h.line_no AND e.lowest < h.after
      WHERE h.opens AND coalesce(h.fn, h.method, h.cls) IS NOT NULL GROUP BY ALL),
    inside AS MATERIALIZED (SELECT l.repo, l.file, l.seq, l.line_no, arg_max(b.name, b.level) FILTER (b.sort = 'c') AS class_name,
        arg_max(b.name, b.level) AS inner_name, arg_max(b.sort, b.level) AS inner_sort
      FROM named_headers l JOIN bodies b ON b.repo = l.repo AND b.file = l.file AND b.seq = l.seq AND l.line_no > b.first AND (b.past IS NULL OR l.line_no < b.past)
      GROUP BY ALL),
    owned AS (SELECT n.*, i.class_name, i.inner_name, i.inner_sort, coalesce(n.fn, CASE WHEN n.method IS NOT NULL THEN coalesce(i.class_name || '.', '') || n.method END) AS own
      FROM named_headers n LEFT JOIN inside i ON i.repo = n.repo AND i.file = n.file AND i.seq = n.seq AND i.line_no = n.line_no),
    scoped AS MATERIALIZED (SELECT *, coalesce(own, CASE inner_sort WHEN 'f' THEN inner_name WHEN 'm' THEN coalesce(class_name || '.', '') || inner_name END, 'root') AS caller FROM owned)""",
    "functions": f"""function_rows AS MATERIALIZED (
      SELECT {KEY}, line_no, fn AS name, CASE fn_kind WHEN 'declaration' THEN {params(ext('line', L.DECLARATION, 5))}
          WHEN 'arrow' THEN {params(ext('line', L.ARROW, 4) + ' || ' + ext('line', L.ARROW, 6))} ELSE {params(ext('line', L.FUNCTION_VALUE, 4))} END AS params,
        CASE fn_kind WHEN 'declaration' THEN {ext('line', L.DECLARATION, 1)} <> '' AND (variant = 'detail' OR {ext('line', L.DECLARATION, 2)} = '')
          WHEN 'arrow' THEN variant = 'detail' AND {ext('line', L.ARROW, 1)} <> '' ELSE variant = 'detail' AND {ext('line', L.FUNCTION_VALUE, 1)} <> '' END AS exported,
        CASE fn_kind WHEN 'declaration' THEN {ext('line', L.DECLARATION, 3)} <> '' WHEN 'arrow' THEN {ext('line', L.ARROW, 3)} || {ext('line', L.ARROW, 5)} <> ''
          ELSE {ext('line', L.FUNCTION_VALUE, 3)} <> '' END AS is_async, fn_kind = 'arrow' AS is_arrow,
        CASE WHEN fn_kind = 'arrow' OR (fn_kind = 'value' AND variant = 'detail' AND {ext('line', L.FUNCTION_VALUE, 1)} <> '') THEN 'arrow' ELSE 'function' END AS type, variant
        FROM scoped, (VALUES ('summary'), ('detail')) v(variant) WHERE fn IS NOT NULL
      UNION ALL SELECT {KEY}, line_no, own, {params(ext('line', L.METHOD, 3))}, false, contains({ext('line', L.METHOD, 1)}, 'async'), false, 'method', variant
        FROM scoped, (VALUES ('summary'), ('detail')) v(variant) WHERE fn IS NULL AND method IS NOT NULL AND (variant = 'detail' OR class_name IS NOT NULL)
      UNION ALL SELECT {KEY}, line_no, name, CAST(params AS VARCHAR[]), variant = 'detail' AND exported, is_async, is_arrow,
        types[CASE variant WHEN 'summary' THEN 1 ELSE 2 END], variant
        FROM {worked('functions', 'name', 'params', 'exported', 'is_async', 'is_arrow', 'types')}, (VALUES ('summary'), ('detail')) v(variant)),
    functions AS MATERIALIZED (SELECT {KEY}, variant, name, min(line_no) AS line_no, bool_or(exported) AS exported,
        CASE WHEN variant = 'detail' THEN bool_or(is_async) ELSE arg_min(is_async, line_no) END AS is_async, arg_min(is_arrow, line_no) AS is_arrow, arg_min(type, line_no) AS type,
        CASE WHEN variant = 'detail' THEN list_distinct_ordered(list(params ORDER BY line_no)) ELSE arg_min(params, line_no) END AS params
      FROM function_rows GROUP BY {KEY}, variant, name)""",
    "classes": f"""class_rows AS (SELECT {KEY}, cls AS name, line_no, nullif({ext('line', L.CLASS, 4)}, '') AS super, {ext('line', L.CLASS, 1)} <> '' AS exported FROM scoped WHERE cls IS NOT NULL),
    class_methods AS (SELECT {KEY}, class_name AS name, method, min(line_no) AS line_no FROM scoped WHERE method IS NOT NULL AND fn IS NULL AND class_name IS NOT NULL GROUP BY ALL),
    classes AS (SELECT c.*, (SELECT list(m.method ORDER BY m.line_no) FROM class_methods m WHERE m.repo = c.repo AND m.file = c.file AND m.seq = c.seq AND m.name = c.name) AS methods
      FROM (SELECT {KEY}, name, min(line_no) AS line_no, arg_min(coalesce(super, ''), line_no) AS extends, bool_or(exported) AS exported FROM class_rows GROUP BY {KEY}, name) c
      UNION ALL SELECT {KEY}, name, line_no, coalesce(super, ''), exported, methods FROM {worked('classes', 'name', 'super', 'exported', 'methods')})""",
    "edges": f"""call_lists AS (SELECT {KEY}, line_no, caller, {ENDPOINT} AS endpoint,
        list_filter(regexp_extract_all(regexp_replace(CASE WHEN method IS NOT NULL THEN regexp_replace({CALLED}, {q(L.METHOD_HEAD)}, ';(') ELSE {CALLED} END,
          {q(L.NOT_CALLED)}, {q(chr(92) + '1;(')}, 'g'), {q(CALL)}, 1), lambda n: n NOT IN {in_list(L.NOT_A_CALL)}) AS names FROM scoped
      UNION ALL SELECT {KEY}, line_no, caller, {of_run('endpoint')}, names FROM {worked('calls', 'caller', 'names', 'endpoint')}),
    edges AS MATERIALIZED (SELECT {KEY}, variant, caller, callee, min({{'l': line_no, 'p': pos}}) AS ord FROM (
        SELECT {KEY}, line_no, variant, caller, unnest(names) AS callee, unnest(generate_series(0, len(names) - 1)) AS pos,
          variant = 'detail' AND {hits('endpoint', L.SOURCE_ENDING)} AS is_request FROM call_lists, (VALUES ('summary'), ('detail')) v(variant) WHERE len(names) > 0)
      WHERE caller <> callee AND NOT (is_request AND callee = 'fetch') GROUP BY {KEY}, variant, caller, callee),
    file_calls AS MATERIALIZED (SELECT {KEY}, caller, endpoint AS path, min(line_no) AS line_no FROM call_lists WHERE {hits('endpoint', L.SOURCE_ENDING)} GROUP BY {KEY}, caller, endpoint)""",
    "routes": f"""routes AS (SELECT {KEY}, line_no, method, CASE WHEN h NOT IN {in_list(L.NOT_A_NAME)} THEN h END AS handler FROM (SELECT *, {ext('line', L.ROUTE)} AS method,
      nullif(coalesce(nullif({ext('line', L.ROUTE_SECOND)}, ''), {ext('line', L.ROUTE_ONLY)}), '') AS h FROM js WHERE {hits('line', L.ROUTE)})
      UNION ALL SELECT {KEY}, line_no, method, handler FROM {worked('routes', 'method', 'handler')})""",
    "deps": f"""deps AS (SELECT {KEY}, regexp_replace(regexp_replace(regexp_replace(source, '(?i)[.][tj]sx?$', ''), '^[.]/', ''), '^/', '') AS dependency, min(line_no) AS line_no
      FROM imports WHERE source LIKE '.%' OR source LIKE '/%' GROUP BY ALL)""",
    "signals": f"""frameworks(pos, word, framework, weight) AS (VALUES {", ".join(f"({i}, {q(w)}, {q(f)}, {x})" for i, (w, f, x) in enumerate(FRAMEWORKS))}),
    signals AS MATERIALIZED (SELECT {KEY}, line_no, pos, framework, weight, word || CASE kind WHEN 'require' THEN ' require' ELSE ' import' END AS reason, variant
        FROM imports JOIN frameworks ON contains(source, word), (VALUES ('summary'), ('detail')) v(variant) WHERE variant = 'summary' OR kind = 'import' OR word = 'express'
      UNION ALL SELECT {KEY}, line_no, 99, 'Express', 0.2, 'router.' || method || ' usage', variant FROM routes, (VALUES ('summary'), ('detail')) v(variant))""",
    "hints": f"""hints AS (SELECT {KEY}, variant, framework, min({{'l': line_no, 'p': pos}}) AS ord, list(reason ORDER BY line_no, pos) AS reasons,
      least(1.0, CAST(arg_min(weight, {{'l': line_no, 'p': pos}}) AS DOUBLE) * 0.4 + 0.6 * sum(CAST(weight AS DOUBLE))) AS confidence FROM signals GROUP BY {KEY}, variant, framework)""",
    "entries": f"""entries AS MATERIALIZED (SELECT {KEY}, variant, name, min(line_no) AS line_no FROM (SELECT {KEY}, variant, name, line_no FROM exports WHERE type = 'default'
      UNION ALL SELECT {KEY}, variant, handler, line_no FROM routes, (VALUES ('summary'), ('detail')) v(variant) WHERE handler IS NOT NULL) GROUP BY {KEY}, variant, name)""",
})


def any_of(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


LOWER_PATH = "lower(f.file)"
CTE["profiles"] = f"""facts AS (SELECT f.*, v.variant,
    (SELECT count(*) FROM imports i WHERE i.repo = f.repo AND i.file = f.file AND i.seq = f.seq) AS import_count,
    (SELECT count(*) FROM exports e WHERE e.repo = f.repo AND e.file = f.file AND e.seq = f.seq AND e.variant = v.variant) AS export_count,
    (SELECT count(*) FROM functions e WHERE e.repo = f.repo AND e.file = f.file AND e.seq = f.seq AND e.variant = v.variant) AS function_count,
    (SELECT count(*) FROM classes e WHERE e.repo = f.repo AND e.file = f.file AND e.seq = f.seq) AS class_count,
    coalesce((SELECT bool_or(contains(source, 'jsonwebtoken')) FROM imports i WHERE i.repo = f.repo AND i.file = f.file AND i.seq = f.seq), false) AS jwt,
    coalesce((SELECT bool_or(contains(source, 'bcrypt')) FROM imports i WHERE i.repo = f.repo AND i.file = f.file AND i.seq = f.seq), false) AS bcrypt,
    coalesce((SELECT bool_or(contains(source, 'express')) FROM imports i WHERE i.repo = f.repo AND i.file = f.file AND i.seq = f.seq), false) AS express,
    coalesce((SELECT list(h.framework ORDER BY h.ord) FROM hints h WHERE h.repo = f.repo AND h.file = f.file AND h.seq = f.seq AND h.variant = v.variant), {NO_TEXTS}) AS frameworks,
    coalesce((SELECT list(e.name ORDER BY e.line_no) FROM entries e WHERE e.repo = f.repo AND e.file = f.file AND e.seq = f.seq AND e.variant = v.variant), {NO_TEXTS}) AS entry_names
    FROM files f, (VALUES ('summary'), ('detail')) v(variant)),
  roles AS (SELECT f.*, CASE
    WHEN {any_of(LOWER_PATH, 'auth', 'login', 'session')} OR jwt OR bcrypt OR {word('lower(content)', 'jwt', 'token')} THEN {q(AUTH)}
    WHEN {any_of(LOWER_PATH, 'controller', 'route')} OR (list_contains(frameworks, 'Express') AND {word('lower(content)', 'router')}) THEN {q(API)}
    WHEN {any_of(LOWER_PATH, 'service')} OR {word('lower(content)', 'service')} THEN {q(SERVICE)}
    WHEN {any_of(LOWER_PATH, 'repository', 'repo')} OR {word('lower(content)', 'schema', 'model')} THEN {q(DATA)}
    WHEN list_contains(frameworks, 'React') OR {LOWER_PATH} LIKE '%.tsx' OR {LOWER_PATH} LIKE '%.jsx' OR {word('content', 'useState', 'useEffect')} THEN {q(UI)}
    WHEN len(list_filter(entry_names, lambda e: {hits('e', ENTRY_HINT)})) > 0 THEN {q(AUTH)}
    WHEN variant = 'detail' AND len(entry_names) > 0 AND contains({LOWER_PATH}, 'page') THEN {q(UI)} ELSE {q(GENERAL)} END AS module_purpose FROM facts f),
  tags(module_purpose, tag_list) AS (VALUES {", ".join(f"({q(k)}, {array(v)})" for k, v in RESPONSIBILITIES.items())}),
  profiles AS MATERIALIZED (SELECT f.* EXCLUDE (content), least(100, 40 + least(50, 8 * import_count + 4 * function_count + 6 * len(frameworks))) AS confidence,
    list_concat(tag_list, CASE WHEN variant = 'detail' AND f.module_purpose = {q(AUTH)} AND bcrypt THEN ['Password Verification'] ELSE {NO_TEXTS} END,
      CASE WHEN variant = 'detail' AND f.module_purpose = {q(AUTH)} AND jwt THEN ['Token Generation', 'Token Validation'] ELSE {NO_TEXTS} END,
      CASE WHEN express AND NOT list_contains(tag_list, 'Routing') THEN ['Routing'] ELSE {NO_TEXTS} END,
      CASE WHEN list_contains(frameworks, 'Next.js') THEN ['Page Rendering'] ELSE {NO_TEXTS} END) AS responsibilities FROM roles f JOIN tags USING (module_purpose))"""
# distinct in first-seen order over a list of lists
CTE["functions"] = CTE["functions"].replace(
    "list_distinct_ordered(list(params ORDER BY line_no))",
    "list_reduce(flatten(list(params ORDER BY line_no)), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"
    .replace("flatten(list(params ORDER BY line_no))", "list_transform(flatten(list(params ORDER BY line_no)), lambda x: [x])"))

JSC = CODE + ["js"]
SCOPED = JSC + ["scoped"]
PROFILE = ["imports", "exports", "scoped", "functions", "classes", "routes", "signals", "hints", "entries", "profiles"]
IMPORT_COLUMNS = f"repo, file, {LINE_NO} AS line_no, source, alias, type, {joined('specifiers')} AS specifiers"

add("ext_imports", JSC + ["imports"], f"SELECT {IMPORT_COLUMNS} FROM imports WHERE kind = 'import'")
add("ext_requires", JSC + ["imports"], f"SELECT {IMPORT_COLUMNS} FROM imports WHERE kind = 'require'")
add("ext_bindings", JSC + ["imports"], f"""SELECT repo, file, {LINE_NO} AS line_no, pos, source, b.imported AS imported, b."local" AS "local"
  FROM (SELECT *, unnest(bindings) AS b, unnest(generate_series(0, len(bindings) - 1)) AS pos FROM imports WHERE len(bindings) > 0)""")
add("ext_exports", JSC + ["exports"], f"SELECT variant, repo, file, {LINE_NO} AS line_no, name, type, alias FROM exports WHERE type = 'named'")
add("ext_default_export", JSC + ["exports"], f"SELECT variant, repo, file, {LINE_NO} AS line_no, name, type, alias FROM exports WHERE type = 'default'")
FN_COLUMNS = f"variant, repo, file, {LINE_NO} AS line_no, name, {joined('params')} AS params, exported, is_async, is_arrow, type"
add("ext_functions", SCOPED + ["functions"], f"SELECT {FN_COLUMNS} FROM function_rows WHERE type <> 'method'")
add("ext_methods", SCOPED + ["functions"], f"SELECT variant, repo, file, {LINE_NO} AS line_no, name, {joined('params')} AS params, is_async FROM function_rows WHERE type = 'method'")
add("ext_classes", SCOPED + ["classes"], f"SELECT repo, file, {LINE_NO} AS line_no, name, nullif(extends, '') AS extends, exported, {joined('methods')} AS methods FROM classes")
add("ext_params", SCOPED + ["functions"], f"""SELECT repo, file, {LINE_NO} AS line_no, name, unnest(generate_series(0, len(params) - 1)) AS pos, unnest(params) AS param
  FROM function_rows WHERE variant = 'detail' AND len(params) > 0""")
add("ext_calls", SCOPED + ["edges"], "SELECT repo, file, caller, callee, CAST(floor(ord.l) AS BIGINT) AS line_no, ord.p AS pos FROM edges WHERE variant = 'summary'")
add("ext_file_calls", SCOPED + ["edges"], f"SELECT repo, file, caller, path, {LINE_NO} AS line_no, 'http' AS type FROM file_calls")
add("ext_routes", JSC + ["routes"], f"SELECT repo, file, {LINE_NO} AS line_no, method, handler FROM routes")
add("ext_merge_symbols", SCOPED + ["functions"], f"SELECT {FN_COLUMNS} FROM functions")
add("ext_backfill_calls", SCOPED + ["functions", "edges"], f"""SELECT f.repo, f.file, f.name, {joined('list(e.callee ORDER BY e.ord) FILTER (e.callee IS NOT NULL)')} AS calls
  FROM functions f LEFT JOIN edges e ON e.repo = f.repo AND e.file = f.file AND e.seq = f.seq AND e.variant = 'summary' AND e.caller = f.name
  WHERE f.variant = 'summary' GROUP BY f.repo, f.file, f.seq, f.name""")
add("ext_deps", JSC + ["imports", "deps"], f"SELECT repo, file, dependency, {LINE_NO} AS line_no FROM deps")
add("ext_frameworks", JSC + ["imports", "routes", "signals"],
    f"SELECT variant, repo, file, {LINE_NO} AS line_no, framework, round(CAST(weight AS DOUBLE), 6) AS weight, reason FROM signals")
add("ext_hint_score", JSC + ["imports", "routes", "signals", "hints"], f"""SELECT repo, file, framework, round(confidence, 6) AS confidence,
  {joined("list_reduce(list_transform(reasons, lambda x: [x]), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))")} AS reason FROM hints WHERE variant = 'summary'""")
add("ext_responsibilities", JSC + PROFILE, f"SELECT variant, repo, file, {joined('responsibilities')} AS responsibilities FROM profiles")
add("ext_confidence", JSC + PROFILE, "SELECT variant, repo, file, CAST(confidence AS BIGINT) AS confidence FROM profiles")
add("ext_status", ["code_corpus"], f"SELECT repo, file, CASE WHEN {file_type('file')} IN {in_list(STATUS_EXTENSIONS)} THEN 'analyzed' ELSE 'unsupported' END AS ast_status FROM corpus")
# roles of both corpora: the second one gets its own names
_ROLE_CODE = ",\n".join(CTE[c].strip() for c in JSC + PROFILE)
_ROLE_LINE = ",\n".join(CTE[c].strip() for c in LINE + ["js"] + PROFILE)
ORACLE["ext_role"] = (f"SELECT variant, repo, file, module_purpose FROM (WITH {_ROLE_CODE} SELECT * FROM profiles) a UNION ALL "
                      f"SELECT 'lines', repo, file, module_purpose FROM (WITH {_ROLE_LINE} SELECT * FROM profiles WHERE variant = 'summary') b")

# --- metadata, joins --------------------------------------------------------------------------
def per_file(columns: str, table: str, where: str = "true") -> str:
    """Correlated list over one file of ``f``."""
    return f"(SELECT {columns} FROM {table} x WHERE x.repo = f.repo AND x.file = f.file AND x.seq = f.seq AND {where})"


CTE["titles"] = """titles AS (SELECT repo, file, list(title ORDER BY first) AS names FROM (
    SELECT repo, file, title, min({'l': line, 'r': rule_ord}) AS first FROM findings GROUP BY ALL) GROUP BY repo, file)"""
S = "x.variant = 'summary'"
add("ext_metadata", CODE + FIND + ["js"] + PROFILE + ["edges", "deps", "titles"], f"""SELECT f.repo, f.file, f.file_type, f.module_purpose, CAST(f.confidence AS BIGINT) AS confidence,
  {per_file('count(*)', 'lines', hits('x.line', NOT_BLANK))} AS lines_of_code, f.function_count, f.class_count, f.import_count, f.export_count,
  {joined(per_file("list(source || ':' || type ORDER BY line_no)", 'imports'))} AS imports,
  {joined(per_file("list(name || ':' || type ORDER BY line_no, pos)", 'exports', S))} AS exports,
  {joined(per_file("list(name || ':' || " + joined("(SELECT list(e.callee ORDER BY e.ord) FROM edges e WHERE e.repo = x.repo AND e.file = x.file AND e.seq = x.seq AND e.variant = 'summary' AND e.caller = x.name)", ",") + " ORDER BY line_no)", 'functions', S))} AS functions,
  {joined(per_file("list(name || ':' || " + joined('methods', ',') + " ORDER BY line_no)", 'classes'))} AS classes,
  {joined(per_file("list(caller || '>' || callee ORDER BY ord)", 'edges', S))} AS call_graph,
  {joined('f.frameworks')} AS frameworks, {joined('t.names')} AS finding_titles, {joined('f.entry_names')} AS entry_points,
  {joined(per_file('list(dependency ORDER BY line_no)', 'deps'))} AS dependencies
  FROM profiles f LEFT JOIN titles t ON t.repo = f.repo AND t.file = f.file WHERE f.variant = 'summary'""")

add("jn_file_findings", LINE + FIND, f"""SELECT f.repo, f.file, f.seq, count(x.id) AS finding_count,
  {joined("list(x.line || ':' || x.title ORDER BY x.line, x.rule_ord) FILTER (x.id IS NOT NULL)")} AS findings
  FROM files f LEFT JOIN findings x ON x.repo = f.repo AND x.file = f.file GROUP BY f.repo, f.file, f.seq""")
add("jn_select_file", LINE + FIND, """SELECT 'one' AS pick, repo, id FROM findings WHERE file = 'src/f1.ts'
  UNION ALL SELECT 'list', repo, id FROM findings WHERE file_type = '.php'""")

SUFFIX_ROWS = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(("",) + IMPORT_SUFFIXES))
CTE["known"] = "known AS MATERIALIZED (SELECT DISTINCT repo, file FROM corpus)"
CTE["targets"] = f"""suffixes(n, suffix) AS (VALUES {SUFFIX_ROWS}),
  bases AS (SELECT *, CASE WHEN source LIKE '/%' THEN {fold('source')} WHEN source LIKE '.%' THEN {fold(parent('file') + " || '/' || source")} END AS base FROM imports),
  targets AS MATERIALIZED (SELECT b.* , t.target FROM bases b LEFT JOIN (SELECT DISTINCT ON (repo, base) repo, base, target FROM (
      SELECT c.repo, c.base, c.n, c.base || c.suffix AS target FROM (SELECT DISTINCT repo, base, n, suffix FROM bases, suffixes WHERE base IS NOT NULL) c
      JOIN (SELECT DISTINCT repo, replace(file, '\\', '/') AS path FROM known) k ON k.repo = c.repo AND k.path = c.base || c.suffix) ORDER BY repo, base, n) t USING (repo, base))"""
CTE["bound"] = f"""binding_rows AS (SELECT {KEY}, line_no, pos, target, b.imported AS imported, b."local" AS bound_name FROM (
      SELECT *, unnest(bindings) AS b, unnest(generate_series(0, len(bindings) - 1)) AS pos FROM targets WHERE target IS NOT NULL AND len(bindings) > 0)),
  bound AS MATERIALIZED (SELECT DISTINCT ON ({KEY}, bound_name) * FROM binding_rows ORDER BY {KEY}, bound_name, line_no, pos),
  default_names AS (SELECT DISTINCT ON (repo, path) repo, replace(file, '\\', '/') AS path, name FROM exports WHERE type = 'default' AND variant = 'detail' ORDER BY repo, path, line_no, pos)"""
CTE["calls"] = """detail_functions AS MATERIALIZED (SELECT repo, file, seq, name, line_no FROM functions WHERE variant = 'detail'),
  call_targets AS (SELECT e.repo, e.file, e.seq, e.caller, e.callee, e.ord, l.name IS NOT NULL AS is_local,
      CASE WHEN l.name IS NULL THEN b.target END AS target_file, CASE WHEN l.name IS NULL THEN CASE WHEN b.imported = 'default' THEN dn.name ELSE b.imported END END AS wanted
    FROM (SELECT * FROM edges WHERE variant = 'detail') e
    LEFT JOIN detail_functions l ON l.repo = e.repo AND l.file = e.file AND l.seq = e.seq AND l.name = e.callee
    LEFT JOIN bound b ON b.repo = e.repo AND b.file = e.file AND b.seq = e.seq AND b.bound_name = e.callee
    LEFT JOIN default_names dn ON dn.repo = e.repo AND dn.path = b.target),
  calls AS MATERIALIZED (SELECT t.*, CASE WHEN r.name IS NOT NULL THEN wanted ELSE callee END AS target_name, is_local OR r.name IS NOT NULL AS resolved
    FROM call_targets t LEFT JOIN (SELECT DISTINCT repo, file, name FROM detail_functions) r ON r.repo = t.repo AND r.file = t.target_file AND r.name = t.wanted)"""
CUT = ext("path", "^[^?#]*", 0)
CTE["requests"] = f"""asked AS (SELECT *, {fold("CASE WHEN bare LIKE '/%' THEN bare ELSE " + parent('file') + " || '/' || bare END")} AS candidate FROM (SELECT *,
      CASE WHEN lower({CUT}) LIKE 'http://%' OR lower({CUT}) LIKE 'https://%' THEN '/' || regexp_replace({CUT}, '(?i)^https?://[^/]*/?', '') ELSE {CUT} END AS bare FROM file_calls)),
  paths AS MATERIALIZED (SELECT repo, {fold('file')} AS path FROM known),
  ends AS (SELECT repo, path, array_to_string(string_split(path, '/')[i:], '/') AS ending FROM (SELECT *, unnest(generate_series(2, len(string_split(path, '/')))) AS i FROM paths)),
  single AS (SELECT repo, ending, min(path) AS path FROM ends GROUP BY ALL HAVING count(*) = 1),
  requests AS MATERIALIZED (SELECT a.*, coalesce(p.path, s.path) AS target FROM asked a LEFT JOIN (SELECT DISTINCT repo, path FROM paths) p ON p.repo = a.repo AND p.path = a.candidate
    LEFT JOIN single s ON s.repo = a.repo AND s.ending = a.candidate)"""
JOINS = ["imports", "exports", "scoped", "functions", "edges", "known", "targets", "bound", "calls", "requests"]
add("jn_import_path", JSC + ["imports", "known", "targets"], f"SELECT repo, file, {LINE_NO} AS line_no, source, target FROM targets")
add("jn_binding", JSC + JOINS, "SELECT repo, file, caller, callee, is_local, target_file, target_name, resolved FROM calls")
add("jn_default_export", JSC + JOINS, """SELECT b.repo, b.file, b.bound_name AS "local", b.target, d.name AS exported_name FROM bound b
  LEFT JOIN default_names d ON d.repo = b.repo AND d.path = b.target WHERE b.imported = 'default'""")


def over_both(name: str, ctes: list[str], select: str, recursive: bool = False) -> None:
    """The same select over both corpora, told apart by ``corpus``."""
    parts = []
    for corpus in ("code", "line"):
        head = ",\n".join(CTE[c].strip() for c in [f"{corpus}_corpus", "files", "lines", "js"] + ctes)
        parts.append(f"SELECT {q(corpus)} AS corpus, z.* FROM (WITH {'RECURSIVE ' if recursive else ''}{head} {select}) z")
    ORACLE[name] = " UNION ALL ".join(parts)


over_both("jn_file_call", ["scoped", "edges", "known", "requests"], "SELECT repo, file, caller, path, target FROM requests")

# --- aggregates, ranks -----------------------------------------------------------------------------
LEVELS = ", ".join(f"count(*) FILTER (severity = {q(s)}) AS {s.lower()}" for s in SEVERITY_WEIGHTS)
add("agg_severity", LINE + FIND, f"SELECT repo, {LEVELS} FROM findings GROUP BY repo")
add("agg_risk", LINE + FIND, "SELECT count(*) AS finding_count, CAST(coalesce(sum(weight), 0) AS BIGINT) AS risk_score FROM findings")
CTE["file_risk"] = 'file_risk AS (SELECT repo, file, count(*) AS "count", CAST(sum(weight) AS BIGINT) AS risk_score, min(seq) AS first_seq FROM findings GROUP BY repo, file)'
add("agg_file_risk", LINE + FIND + ["file_risk"], 'SELECT repo, file, "count", risk_score FROM file_risk')
RESULT = CODE + FIND + ["js"] + PROFILE + ["deps"]
CTE["summary"] = "summary AS (SELECT * FROM profiles WHERE variant = 'summary')"


def first_seen(value: str, order: str, rows: str, limit: int, key: str = "repo, module_purpose") -> str:
    return (f"(SELECT {key}, list({value} ORDER BY o)[1:{limit}] AS v FROM (SELECT {key}, {value}, min({order}) AS o FROM {rows} GROUP BY ALL) GROUP BY {key})")


CTE["modules"] = f"""module_titles AS (SELECT p.repo, p.module_purpose, p.seq, f.title, f.line, f.rule_ord FROM summary p JOIN findings f USING (repo, file)),
  module_deps AS (SELECT p.repo, p.module_purpose, p.seq, d.dependency, d.line_no FROM summary p JOIN deps d USING (repo, file, seq)),
  module_frameworks AS (SELECT p.repo, p.module_purpose, p.seq, h.framework, h.ord FROM summary p JOIN hints h USING (repo, file, seq) WHERE h.variant = 'summary'),
  module_base AS (SELECT p.repo, p.module_purpose, count(DISTINCT p.file) AS file_count, count(f.id) AS finding_count, CAST(coalesce(sum(f.weight), 0) AS BIGINT) AS risk_score, min(p.seq) AS first_seq
    FROM summary p LEFT JOIN findings f ON f.repo = p.repo AND f.file = p.file GROUP BY p.repo, p.module_purpose),
  modules AS MATERIALIZED (SELECT b.*, t.v AS top_findings, d.v AS dependencies, w.v AS frameworks,
      row_number() OVER (PARTITION BY repo ORDER BY risk_score DESC, finding_count DESC, first_seq) AS rank FROM module_base b
    LEFT JOIN {first_seen('title', "{'s': seq, 'l': line, 'r': rule_ord}", 'module_titles', A.MODULE_TITLES)} t USING (repo, module_purpose)
    LEFT JOIN {first_seen('dependency', "{'s': seq, 'l': line_no}", 'module_deps', A.MODULE_DEPS)} d USING (repo, module_purpose)
    LEFT JOIN {first_seen('framework', "{'s': seq, 'o': ord}", 'module_frameworks', A.MODULE_FRAMEWORKS)} w USING (repo, module_purpose))"""
CTE["repos"] = f"""repos AS MATERIALIZED (SELECT c.repo, c.n AS file_count, coalesce(s.n, 0) AS scanned_file_count, coalesce(f.n, 0) AS finding_count, coalesce(f.risk, 0) AS risk_score,
      coalesce(f.critical, 0) AS critical, coalesce(f.high, 0) AS high, coalesce(f.medium, 0) AS medium, coalesce(f.low, 0) AS low, w.v AS frameworks, d.v AS dependencies
    FROM (SELECT repo, count(*) AS n FROM corpus GROUP BY repo) c LEFT JOIN (SELECT repo, count(*) AS n FROM summary GROUP BY repo) s USING (repo)
    LEFT JOIN (SELECT repo, count(*) AS n, CAST(sum(weight) AS BIGINT) AS risk, {LEVELS} FROM findings GROUP BY repo) f USING (repo)
    LEFT JOIN {first_seen('framework', "{'s': seq, 'o': ord}", "(SELECT * FROM hints WHERE variant = 'summary')", A.REPO_FRAMEWORKS, 'repo')} w USING (repo)
    LEFT JOIN {first_seen('dependency', "{'s': seq, 'l': line_no}", 'deps', A.REPO_DEPS, 'repo')} d USING (repo))"""
ROLLUP = RESULT + ["summary", "modules", "repos"]
LISTS = f"{joined('dependencies')} AS dependencies, {joined('frameworks')} AS frameworks"
add("agg_module", ROLLUP, f"SELECT repo, module_purpose, file_count, finding_count, risk_score, {joined('top_findings')} AS top_findings, {LISTS} FROM modules")
add("agg_module_files", RESULT + ["summary"], "SELECT repo, module_purpose, seq, file FROM summary")
add("agg_ordered_distinct", LINE + FIND, f"SELECT repo, {joined('v')} AS titles FROM {first_seen('title', chr(123) + chr(39) + 's' + chr(39) + ': seq, ' + chr(39) + 'l' + chr(39) + ': line, ' + chr(39) + 'r' + chr(39) + ': rule_ord}', 'findings', 7, 'repo')}")
add("agg_repo", ROLLUP, f"SELECT repo, file_count, scanned_file_count, finding_count, risk_score, critical, high, medium, low, {LISTS} FROM repos")
add("agg_overview", ROLLUP, f"""SELECT repo, pos, label, value, subtext FROM (
  SELECT repo, CAST(1 AS BIGINT) AS pos, 'Files opened' AS label, scanned_file_count AS value, file_count || ' discovered' AS subtext FROM repos
  UNION ALL SELECT repo, 2, 'Risk score', risk_score, {q(A.WEIGHTS_TEXT)} FROM repos
  UNION ALL SELECT repo, 3, 'Findings', finding_count, critical || ' critical, ' || high || ' high' FROM repos
  UNION ALL SELECT r.repo, 4, 'Modules', (SELECT count(*) FROM modules m WHERE m.repo = r.repo), coalesce(nullif({joined('frameworks[1:3]', ', ')}, ''), {q(A.NO_FRAMEWORK_TEXT)}) FROM repos r)""")
add("agg_titles", LINE + FIND + ["titles"], f"SELECT repo, file, {joined('names')} AS finding_titles FROM titles")
add("rnk_hotspots", LINE + FIND + ["file_risk"], """SELECT * FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY risk_score DESC, first_seq, file) AS rank, file, "count", risk_score FROM file_risk) WHERE rank <= 5""")
add("rnk_modules", ROLLUP, "SELECT repo, rank, module_purpose, risk_score, finding_count FROM modules")
CTE["payload_files"] = f"""payload_files AS MATERIALIZED (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.repo ORDER BY f.seq, f.file) AS rank,
      (SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) FROM findings x WHERE x.repo = f.repo AND x.file = f.file) AS risk,
      (SELECT list(x.line || ':' || x.title ORDER BY x.line, x.rule_ord)[1:8] FROM findings x WHERE x.repo = f.repo AND x.file = f.file) AS items,
      {per_file('list(dependency ORDER BY line_no)[1:5]', 'deps')} AS dependencies, {per_file('count(*)', 'lines', hits('x.line', NOT_BLANK))} AS loc FROM summary f) WHERE rank <= 25)"""
add("rnk_payload_caps", ROLLUP + ["payload_files"], f"""SELECT repo, file, rank, risk, module_purpose, {joined('entry_names[1:5]')} AS entry_points,
  {joined('frameworks[1:5]')} AS frameworks, {joined('dependencies')} AS dependencies, {joined('items')} AS findings FROM payload_files""")
add("rnk_listing", ["line_corpus"], "SELECT * FROM (SELECT repo, file, seq, row_number() OVER (PARTITION BY repo ORDER BY seq, file) AS rank FROM corpus) WHERE rank <= 80")
add("rnk_selected_first", LINE, "SELECT repo, file, seq FROM files ORDER BY file <> 'src/f1.ts', repo, seq")

add("snk_tables", ROLLUP + ["file_risk"], """SELECT 'findings' AS "table", repo, count(*) AS n FROM findings GROUP BY repo
  UNION ALL SELECT 'metadata', repo, count(*) FROM summary GROUP BY repo UNION ALL SELECT 'module_files', repo, count(*) FROM summary GROUP BY repo
  UNION ALL SELECT 'modules', repo, count(*) FROM modules GROUP BY repo UNION ALL SELECT 'hotspots', repo, least(5, count(*)) FROM file_risk GROUP BY repo
  UNION ALL SELECT 'repos', repo, 1 FROM repos UNION ALL SELECT 'payloads', repo, 1 FROM repos""")

# --- merge --------------------------------------------------------------------------------------------
add("set_known_files", ["code_corpus", "files"], "SELECT repo, file FROM corpus WHERE seq % 3 = 0 UNION SELECT repo, file FROM files")
add("set_merge_metadata", LINE, f"""SELECT repo, file, CASE WHEN seq % 4 <> 0 AND seq % 3 = 0 THEN 1 ELSE count(*) FILTER ({hits('line', NOT_BLANK)}) END AS loc,
  CAST(CASE WHEN seq % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS version, CAST(0 AS BIGINT) AS first_version, seq AS first_seq FROM lines GROUP BY repo, file, seq""")
add("set_merge_findings", LINE + FIND, """SELECT 'keep' AS mode, repo, id, CAST(CASE WHEN seq % 4 <> 0 AND seq % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS version FROM findings
  UNION ALL SELECT 'replace', repo, id, CASE WHEN seq % 4 <> 0 THEN 1 ELSE 0 END FROM findings WHERE seq % 4 = 0 OR seq % 3 <> 0""")
add("set_merge_summary", LINE + FIND, f"""SELECT r.repo, CASE WHEN r.repo = 'repo3' THEN 1 ELSE c.n END AS file_count, r.n AS scanned_file_count, coalesce(f.finding_count, 0) AS finding_count,
  coalesce(f.risk_score, 0) AS risk_score, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
  FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo) r JOIN (SELECT repo, count(*) AS n FROM corpus GROUP BY repo) c USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS finding_count, CAST(sum(weight) AS BIGINT) AS risk_score, {LEVELS} FROM findings GROUP BY repo) f USING (repo)""")

# --- graph ------------------------------------------------------------------------------------------------
CTE["graph"] = """links AS MATERIALIZED (
    SELECT c.repo, c.seq, c.file, 1 AS phase, c.ord.l AS line, c.ord.p AS pos, 'function:' || c.file || ':' || CASE WHEN d.name IS NULL THEN '<module>' ELSE c.caller END AS source, d.name IS NULL AS from_module,
      CASE WHEN c.resolved THEN 'function:' ELSE 'external:' END || coalesce(c.target_file, c.file) || ':' || c.target_name AS target, c.target_name AS name, coalesce(c.target_file, c.file) AS file_path,
      CASE WHEN c.resolved THEN 'function' ELSE 'external' END AS kind, CAST(NULL AS VARCHAR) AS label, c.resolved
    FROM calls c LEFT JOIN detail_functions d ON d.repo = c.repo AND d.file = c.file AND d.seq = c.seq AND d.name = c.caller WHERE d.name IS NOT NULL OR c.caller = 'root'
    UNION ALL SELECT r.repo, r.seq, r.file, 2, r.line_no, 0, 'function:' || r.file || ':' || CASE WHEN d.name IS NULL THEN '<module>' ELSE r.caller END, d.name IS NULL,
      CASE WHEN r.target IS NULL THEN 'external:' || r.file || ':' || r.path ELSE 'file:' || r.target END, string_split(coalesce(r.target, r.path), '/')[-1], coalesce(r.target, r.path),
      CASE WHEN a.path IS NULL THEN 'external' ELSE 'file' END, 'HTTP', a.path IS NOT NULL
    FROM requests r LEFT JOIN detail_functions d ON d.repo = r.repo AND d.file = r.file AND d.seq = r.seq AND d.name = r.caller
    LEFT JOIN (SELECT DISTINCT repo, replace(file, '\\', '/') AS path FROM files) a ON a.repo = r.repo AND a.path = r.target WHERE d.name IS NOT NULL OR r.caller = 'root'),
  mentions AS (SELECT repo, 'function:' || file || ':' || name AS id, name, file AS file_path, 'function' AS kind, {'p': 0, 's': seq, 'f': file, 'l': line_no, 'o': 0, 'u': 0} AS node_ord FROM detail_functions
    UNION ALL SELECT repo, source, 'module', file, 'function', {'p': phase, 's': seq, 'f': file, 'l': line, 'o': pos, 'u': 0} FROM links WHERE from_module
    UNION ALL SELECT repo, target, name, file_path, kind, {'p': phase, 's': seq, 'f': file, 'l': line, 'o': pos, 'u': 1} FROM links),
  nodes AS MATERIALIZED (SELECT DISTINCT ON (repo, id) * FROM mentions ORDER BY repo, id, node_ord),
  graph_edges AS MATERIALIZED (SELECT DISTINCT ON (repo, source, target) * FROM links ORDER BY repo, source, target, phase, seq, file, line, pos)"""
GRAPH = JOINS + ["graph"]
over_both("gr_nodes", GRAPH, "SELECT repo, id, name, file_path, kind FROM nodes")
over_both("gr_call_edges", GRAPH, "SELECT repo, source, target, resolved FROM graph_edges WHERE label IS NULL")
over_both("gr_file_edges", GRAPH, "SELECT repo, source, target, label, resolved FROM graph_edges WHERE label = 'HTTP'")
DEPTH = 64
CTE["walk"] = f"""walk(repo, id, depth) AS (SELECT repo, id, 0 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.repo = n.repo AND e.target = n.id)
    UNION SELECT w.repo, e.target, w.depth + 1 FROM walk w JOIN graph_edges e ON e.repo = w.repo AND e.source = w.id WHERE w.depth < {DEPTH}),
  reached AS (SELECT repo, id, min(depth) AS rank FROM walk GROUP BY repo, id),
  ranks AS MATERIALIZED (SELECT n.repo, n.id, n.node_ord, CAST(coalesce(r.rank, coalesce(m.deepest, 0) + 1) AS BIGINT) AS rank FROM nodes n LEFT JOIN reached r USING (repo, id)
    LEFT JOIN (SELECT repo, max(rank) AS deepest FROM reached GROUP BY repo) m USING (repo))"""
over_both("gr_rank", GRAPH + ["walk"], "SELECT repo, id, rank FROM ranks", recursive=True)
LINE_GRAPH = LINE + ["js"] + GRAPH
add("gr_layout", LINE_GRAPH + ["walk"], f"""SELECT repo, id, rank * {COLUMN_WIDTH} AS x, (row_number() OVER (PARTITION BY repo, rank ORDER BY node_ord, id) - 1) * {ROW_HEIGHT} AS y FROM ranks""", recursive=True)
over_both("agg_graph", GRAPH, """SELECT n.repo, coalesce(f.n, 0) AS total_functions, n.n AS node_count, coalesce(e.n, 0) AS edge_count, n.entry_nodes, n.max_in_degree
  FROM (SELECT repo, count(*) AS n, count(*) FILTER (d = 0) AS entry_nodes, max(d) AS max_in_degree FROM (SELECT n.repo, n.id, count(e.source) AS d FROM nodes n
      LEFT JOIN graph_edges e ON e.repo = n.repo AND e.target = n.id GROUP BY n.repo, n.id) GROUP BY repo) n
  LEFT JOIN (SELECT repo, count(*) AS n FROM graph_edges GROUP BY repo) e USING (repo) LEFT JOIN (SELECT repo, count(*) AS n FROM detail_functions GROUP BY repo) f USING (repo)""")
over_both("gr_caps", GRAPH, f"""SELECT repo, count(DISTINCT n.id) > {NODE_CAP} OR count(DISTINCT e.eid) > {EDGE_CAP} AS truncated, least(count(DISTINCT n.id), {NODE_CAP}) AS nodes,
    least(count(DISTINCT e.eid) FILTER (e.inside), {EDGE_CAP}) AS edges
  FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY node_ord, id) AS r FROM nodes) n LEFT JOIN (SELECT g.repo, g.source || '->' || g.target AS eid, s.r <= {NODE_CAP} AND t.r <= {NODE_CAP} AS inside
    FROM graph_edges g JOIN (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY node_ord, id) AS r FROM nodes) s ON s.repo = g.repo AND s.id = g.source
    JOIN (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY node_ord, id) AS r FROM nodes) t ON t.repo = g.repo AND t.id = g.target) e USING (repo) GROUP BY repo""")

# --- payloads ---------------------------------------------------------------------------------------------------
add("pay_compact", ROLLUP + ["payload_files", "file_risk"], f"""SELECT repo, 'repo|' || file_count || '|' || risk_score || '|' || {joined('frameworks', ',')} AS item FROM repos
  UNION ALL SELECT repo, 'hotspot|' || file || '|' || risk_score FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY risk_score DESC, first_seq, file) AS r FROM file_risk) WHERE r <= 5
  UNION ALL SELECT repo, 'module|' || module_purpose || '|' || finding_count || '|' || {joined('dependencies[1:5]', ',')} FROM modules WHERE rank <= 8
  UNION ALL SELECT repo, 'file|' || file || '|' || risk || '|' || loc || '|' || {joined('items', ',')} FROM payload_files""")
add("pay_key", [], """SELECT doc_id, length(text) || ':' || list_reduce(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT)) AS key FROM documents""")
add("pay_cache", LINE + FIND, """SELECT f.repo, f.seq, f.id, c.result IS NOT NULL AS hit, c.result FROM findings f
  LEFT JOIN (SELECT code, arg_max(repo || '/' || id, {'s': seq, 'r': repo || '/' || id}) AS result FROM findings WHERE seq % 2 = 0 GROUP BY code) c ON c.code = f.code""")


def filled(template: str, **values: str) -> str:
    out = q(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


add("pay_prompt_repo", [], "SELECT page_id, " + filled(
    P.REPO_PROMPT, mode=f"CASE WHEN page_id % 2 = 0 THEN {q(P.MODE_TEXT['dev'])} ELSE {q(P.MODE_TEXT['repo'])} END", url="url",
    payload="'{\"id\":' || page_id || '}'") + " AS prompt FROM pages")
add("pay_prompt_finding", LINE + FIND, "SELECT repo, id, md5(" + filled(
    P.FINDING_PROMPT, title="title", file="file", line="line", code="code", snippet="context") + ") AS prompt_md5 FROM findings")
D = "x.variant = 'detail'"
FN_TEXT = "name || '() · line ' || CAST(floor(line_no) AS BIGINT) || CASE WHEN is_async THEN ' · async' ELSE '' END"
CLASS_TEXT = "name || CASE WHEN extends <> '' THEN ' extends ' || extends ELSE '' END || ' · ' || coalesce(len(methods), 0) || ' methods'"
BIND_TEXT = "CASE WHEN len(bindings) = 0 THEN 'side effect' ELSE array_to_string(list_transform(bindings, lambda b: b.imported || ' as ' || b.\"local\"), ', ') END"
add("pay_listing", JSC + PROFILE, f"""SELECT f.repo, f.file,
  {joined(per_file(f"list({FN_TEXT} ORDER BY line_no)", 'functions', D))} AS functions,
  {joined(per_file("list(name || ' · ' || type || ' · line ' || CAST(floor(line_no) AS BIGINT) ORDER BY line_no, pos)", 'exports', D))} AS exports,
  {joined(per_file(f"list({CLASS_TEXT} ORDER BY line_no)", 'classes'))} AS classes,
  {joined(per_file("list(framework || ' · ' || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% confidence' ORDER BY ord)", 'hints', D))} AS frameworks,
  {joined(per_file(f"list(source || ' → ' || {BIND_TEXT} ORDER BY line_no)", 'imports'))} AS imports
  FROM profiles f WHERE f.variant = 'detail'""")

# --- streaming: the same rows as a batch run --------------------------------------------------------------------------
add("str_scan", LINE + FIND, f"SELECT repo, id, seq, CAST(line AS BIGINT) AS line, severity, {level_case('title', 'source', 'context')} AS story_confidence FROM findings")
LINE_RESULT = LINE + FIND + ["js"] + PROFILE + ["summary"]
add("str_merge", LINE_RESULT, """SELECT 'finding' AS kind, repo, id AS key, severity AS value FROM findings
  UNION ALL SELECT 'file', repo, file, module_purpose FROM summary""")
add("str_summary", LINE_RESULT + ["deps", "repos"], "SELECT repo, file_count, scanned_file_count, finding_count, risk_score, critical, high, medium, low FROM repos")

# --- metrics --------------------------------------------------------------------------------------------------------------
CTE["outcome"] = f"""doc_lines AS (SELECT doc_id, unnest(string_split_regex(text, {q(chr(92) + 'r?' + chr(92) + 'n')})) AS line FROM documents),
  outcome AS (SELECT l.doc_id, count(*) FILTER ({hits('line', NOT_BLANK)}) AS loc, l.quality = 0 AS vulnerable,
      bool_or({hits('line', RULES[0].pattern)} AND NOT contains(line, 'scan-ignore') AND NOT list_contains(list_transform({array(COMMENT_MARKERS)}, lambda m: starts_with({trim('line')}, m)), true)) AS alert
    FROM labels l JOIN doc_lines d USING (doc_id) GROUP BY l.doc_id, l.quality)"""
add("ev_scores", ["outcome"], """SELECT *, CASE WHEN true_alerts + false_alerts > 0 THEN round(true_alerts / (true_alerts + false_alerts), 6) ELSE 0.0 END AS precision,
  CASE WHEN true_alerts + missed > 0 THEN round(true_alerts / (true_alerts + missed), 6) ELSE 0.0 END AS recall,
  CASE WHEN 2 * true_alerts + missed + false_alerts > 0 THEN round(2 * true_alerts / (2 * true_alerts + missed + false_alerts), 6) ELSE 0.0 END AS f1
  FROM (SELECT count(*) FILTER (alert AND vulnerable) AS true_alerts, count(*) FILTER (vulnerable AND NOT alert) AS missed, count(*) FILTER (alert AND NOT vulnerable) AS false_alerts FROM outcome)""")
add("ev_density", ["outcome"], """SELECT false_alerts, "lines", round(1000 * false_alerts / "lines", 6) AS per_thousand_lines FROM (
  SELECT count(*) FILTER (alert AND NOT vulnerable) AS false_alerts, CAST(sum(loc) AS BIGINT) AS "lines" FROM outcome)""")
add("ev_by_group", LINE + FIND, """SELECT g.file_type, g.title, t.n AS files, g.n AS files_hit, round(g.n / t.n, 6) AS rate FROM (
    SELECT file_type, title, count(DISTINCT repo || ':' || file) AS n FROM findings GROUP BY GROUPING SETS ((file_type, title), (file_type), (title), ())) g
  JOIN (SELECT file_type, count(*) AS n FROM files GROUP BY ROLLUP (file_type)) t ON g.file_type IS NOT DISTINCT FROM t.file_type""")
