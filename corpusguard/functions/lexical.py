"""Lexical patterns and column expressions for JavaScript and TypeScript statements.

They read one row of ``layout`` each: ``line``, the statement, and ``head``, in which
strings are empty and everything nested inside the first bracket level is a mark, so
parameters and patterns of any depth are flat text. Loops that could backtrack are
possessive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.functions.layout import BRACES, BRACKETS
from corpusguard.rules import W

I = r"[A-Za-z_$][0-9A-Za-z_$]*"
STRING = r"""(?:'([^']+)'|"([^"]+)")"""

PARAMS = r"\(([^()]*)\)"
TYPED = r"(?::(?:[^=]|=>)*)?"
# optional type parameters; two runs of white space never stand side by side in these patterns
GENERIC = rf"(?:{W}*<[^>]*>)?"
TAIL = rf"{W}*(?:[;,][^\n]*)?\z"

IMPORT_FROM = rf"^{W}*import({W}[^'\"]*|[{{*][^'\"]*)from{W}*{STRING}"
IMPORT_ONLY = rf"^{W}*import{W}*{STRING}"
CLAUSE_DEFAULT = rf"^({I}){W}*(?:,|\z)"
CLAUSE_NAMESPACE = rf"\*{W}*as{W}+({I})"
CLAUSE_NAMED = r"\{([^}]*)\}"
CLAUSE_TYPE = rf"^type{W}+"
NAMED_ITEM = rf"^(?:type{W}+)?({I})(?:{W}+as{W}+({I}))?\z"
REQUIRE = rf"^{W}*(?:export{W}+)?(?:const|let|var){W}+({I}|\{{[^{{}}]*\}}){W}*{TYPED}={W}*require{W}*\({W}*''{W}*\){TAIL}"
REQUIRED = rf"require{W}*\({W}*{STRING}"
REQUIRE_ITEM = rf"^({I}){W}*(?::{W}*({I})\z|:|=|\z)"

DECLARATION = rf"^{W}*(export{W}+)?(default{W}+)?(async{W}+)?function(?:{W}*\*{W}*|{W}+)({I}){GENERIC}{W}*{PARAMS}"
ARROW = rf"^{W}*(export{W}+)?(?:const|let|var){W}+({I}){W}*{TYPED}={W}*(?:(async{W}*)?{PARAMS}|(async{W}+)?({I})){W}*{TYPED}=>"
FUNCTION_VALUE = rf"^{W}*(export{W}+)?(?:const|let|var){W}+({I}){W}*{TYPED}={W}*(async{W}+)?function(?:{W}*\*)?(?:{W}*{I})?{GENERIC}{W}*{PARAMS}"
CLASS = rf"^{W}*(export{W}+)?(default{W}+)?(?:abstract{W}+)?class{W}+({I})(?:{W}*<[^>]*>)?(?:{W}+extends{W}+({I})(?:[^0-9A-Za-z_$.(]|\z))?"
METHOD = rf"^{W}+((?:(?:static|async|get|set|public|private|protected|readonly|override){W}+)*)(?:\*{W}*)?({I}){GENERIC}{W}*{PARAMS}{W}*(?::[^{{]*)?\{{"

EXPORT_VARIABLE = rf"^{W}*export{W}+(?:const|let|var){W}+({I})"
EXPORT_LIST = rf"^{W}*export{W}*(?:type{W}+)?\{{([^}}]*)\}}"
EXPORT_NAMESPACE = rf"^{W}*export{W}*\*{W}*as{W}+({I}){W}+from"
EXPORT_DEFAULT = rf"^{W}*export{W}+default(?:[^0-9A-Za-z_$]|\z)"
EXPORT_DEFAULT_NAME = rf"^{W}*export{W}+default{W}+({I}){TAIL}"

# Possessive loops and the look-behind keep long strings and long words linear and free of recursion.
QUOTED = r"""'(?:[^'\\]|\\[^\n])*+'|"(?:[^"\\]|\\[^\n])*+"|`[^`]*+`"""

NOT_CALLED = rf"(^|[^0-9A-Za-z_$])(?:function(?:{W}*\*)?|new{W})(?:{W}*[0-9A-Za-z_$.]+)?{W}*\("
METHOD_HEAD = rf"^{W}+[^(]*\("
CALL = rf"(?<![0-9A-Za-z_$])({I}+){W}*\("
FILE_CALL = rf"""(?:^|[^0-9A-Za-z_$])fetch{W}*\({W}*(?:'([^'\\]*)'|"([^"\\]*)"|`([^`$\\]*)`)"""
ROUTE = rf"(?:^|[^0-9A-Za-z_$.])(?:router|app)\.(get|post|put|delete|patch|use){W}*\("
ROUTE_SECOND = rf"(?:^|[^0-9A-Za-z_$.])(?:router|app)\.(?:get|post|put|delete|patch|use){W}*\([^,()]*,{W}*({I}){W}*[,)]"
ROUTE_ONLY = rf"(?:^|[^0-9A-Za-z_$.])(?:router|app)\.(?:get|post|put|delete|patch|use){W}*\({W}*({I}){W}*\)"

# Words that are not names of calls, methods or default exports,
# and the endings of a request path that point to a source file.
NOT_A_CALL = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "async", "void",
              "delete", "new", "in", "of", "do", "else", "super", "import", "with", "yield", "throw", "case")
NOT_A_METHOD = ("if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "super", "await",
                "new", "typeof", "throw", "case")
NOT_A_NAME = ("function", "class", "async", "new", "null", "true", "false", "this", "extends")
SOURCE_ENDING = r"(?i)\.(?:js|jsx|ts|tsx|py|php|c|cpp|h|hpp|java|cs)(?:[?#]|\z)"

def either(line: Column, pattern: str, *groups: int) -> Column:
    """The one alternative group that matched."""
    return T.or_null(F.concat(*[F.regexp_extract(line, pattern, g) for g in groups]))


def present(line: Column, pattern: str, *groups: int) -> Column:
    return F.concat(*[F.regexp_extract(line, pattern, g) for g in groups]) != ""


def items(text: Column) -> Column:
    """Comma-separated, trimmed, non-blank items."""
    parts = F.transform(F.split(text, ","), T.full_trim)
    return F.filter(parts, lambda p: p != "")


PARAM_NAME = rf"^({I})(?:{W}*\?)?{W}*(?:[:=][^\n]*)?\z"
PARAM_REST = rf"^(\.\.\.){W}*({I})"


def params(text: Column) -> Column:
    """Names in a flat list of parameters: defaults stripped, rest as ``...x``, patterns as ``{...}`` / ``[...]``."""
    def name(p: Column) -> Column:
        return (F.when(p.rlike(PARAM_NAME), F.regexp_extract(p, PARAM_NAME, 1))
                .when(p.rlike(PARAM_REST), F.concat(F.lit("..."), F.regexp_extract(p, PARAM_REST, 2)))
                .when(p.startswith(BRACES) & ~p.contains("="), F.lit("{...}"))
                .when(p.startswith(BRACKETS) & ~p.contains("="), F.lit("[...]"))
                .otherwise(F.lit("")))
    return F.filter(F.transform(items(text), name), lambda p: p != "")


def import_clause(line: Column) -> Column:
    return F.regexp_replace(T.full_trim(F.regexp_extract(line, IMPORT_FROM, 1)), CLAUSE_TYPE, "")


def named_pairs(list_text: Column, pattern: str = NAMED_ITEM) -> Column:
    """Array of (first, second) names from the text of a brace list."""
    good = F.filter(items(F.coalesce(list_text, F.lit(""))), lambda p: p.rlike(pattern))
    return F.transform(good, lambda p: F.struct(
        F.regexp_extract(p, pattern, 1).alias("first"),
        T.or_null(F.regexp_extract(p, pattern, 2)).alias("second")))


def called_names(line: Column, method: Column | None = None) -> Column:
    """Names in call position, in text order: the last name of a member chain. The name of a ``method`` header is none."""
    quoted = line.contains("'") | line.contains('"') | line.contains("`")
    code = F.when(quoted, F.regexp_replace(line, QUOTED, "''")).otherwise(line)
    if method is not None:
        code = F.when(method, F.regexp_replace(code, METHOD_HEAD, ";(")).otherwise(code)
    worded = line.contains("function") | line.contains("new")
    code = F.when(worded, F.regexp_replace(code, NOT_CALLED, "$1;(")).otherwise(code)
    names = F.regexp_extract_all(code, F.lit(CALL), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*NOT_A_CALL))


def is_method_header(head: Column) -> Column:
    return head.rlike(METHOD) & ~F.regexp_extract(head, METHOD, 2).isin(*NOT_A_METHOD)


def file_endpoint(line: Column) -> Column:
    """The literal path of a fetch call when it ends like a source file."""
    path = either(line, FILE_CALL, 1, 2, 3)
    return F.when(path.rlike(SOURCE_ENDING), path)
