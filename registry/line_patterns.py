"""What the SQL reads of code: patterns for formatted files, one statement per line.

They know nothing of the library's layout: comments and templates are masked piece by
piece, the headers that the formatted modules of the code corpus spread over several
lines are brought onto one, and brackets are matched as deep as those modules nest them.
Files that need more than that are in ``corpora.WORKED``, with rows worked out by hand.
"""

from __future__ import annotations

from corpusguard.rules import W

I = r"[A-Za-z_$][0-9A-Za-z_$]*"
STRING = r"""(?:'([^']+)'|"([^"]+)")"""

def nested(levels: int) -> str:
    """Text with balanced parentheses, ``levels`` deep; as many as there are."""
    inner = "[^()]*"
    for _ in range(levels):
        inner = rf"[^()]*(?:\({inner}\)[^()]*)*"
    return inner


PARAMS = rf"\(({nested(4)})\)"
TYPED = r"(?::[^=]*)?"
# optional type parameters; two runs of white space never stand side by side in these patterns
GENERIC = rf"(?:{W}*<[^>]*>)?"
TAIL = rf"{W}*(?:;[^\n]*|//[^\n]*)?\z"

IMPORT_FROM = rf"^{W}*import({W}[^'\"]*|[{{*][^'\"]*)from{W}*{STRING}"
IMPORT_ONLY = rf"^{W}*import{W}*{STRING}"
CLAUSE_DEFAULT = rf"^({I}){W}*(?:,|\z)"
CLAUSE_NAMESPACE = rf"\*{W}*as{W}+({I})"
CLAUSE_NAMED = r"\{([^}]*)\}"
CLAUSE_TYPE = rf"^type{W}+"
NAMED_ITEM = rf"^(?:type{W}+)?({I})(?:{W}+as{W}+({I}))?\z"
PATTERN = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
REQUIRE = rf"^{W}*(?:export{W}+)?(?:const|let|var){W}+({I}|{PATTERN}){W}*{TYPED}={W}*require{W}*\({W}*{STRING}{W}*\){TAIL}"
REQUIRE_ITEM = rf"^({I}){W}*(?::{W}*({I})\z|:|=|\z)"

DECLARATION = rf"^{W}*(export{W}+)?(default{W}+)?(async{W}+)?function(?:{W}*\*{W}*|{W}+)({I}){GENERIC}{W}*{PARAMS}"
ARROW = rf"^{W}*(export{W}+)?(?:const|let|var){W}+({I}){W}*{TYPED}={W}*(?:(async{W}*)?{PARAMS}|(async{W}+)?({I})){W}*{TYPED}=>"
FUNCTION_VALUE = rf"^{W}*(export{W}+)?(?:const|let|var){W}+({I}){W}*{TYPED}={W}*(async{W}+)?function(?:{W}*\*)?(?:{W}*{I})?{GENERIC}{W}*{PARAMS}"
CLASS = rf"^{W}*(export{W}+)?(default{W}+)?(?:abstract{W}+)?class{W}+({I})(?:{W}*<[^>]*>)?(?:{W}+extends{W}+({I})(?:[^0-9A-Za-z_$.(]|\z))?"
METHOD = rf"^{W}+((?:(?:static|async|get|set|public|private|protected|readonly|override){W}+)*)(?:\*{W}*)?({I}){GENERIC}{W}*{PARAMS}{W}*(?::[^{{]*)?\{{"
OPENS = rf"\{{{W}*\z"

EXPORT_VARIABLE = rf"^{W}*export{W}+(?:const|let|var){W}+({I})"
EXPORT_LIST = rf"^{W}*export{W}*(?:type{W}+)?\{{([^}}]*)\}}"
EXPORT_NAMESPACE = rf"^{W}*export{W}*\*{W}*as{W}+({I}){W}+from"
EXPORT_DEFAULT = rf"^{W}*export{W}+default(?:[^0-9A-Za-z_$]|\z)"
EXPORT_DEFAULT_NAME = rf"^{W}*export{W}+default{W}+({I}){TAIL}"

QUOTED = r"""'(?:[^'\\]|\\[^\n])*'|"(?:[^"\\]|\\[^\n])*"|`[^`]*`"""

LINE_COMMENT = r"//[^\n]*"

# A text in pieces: strings, templates and comments whole, the rest in between.
PIECE = r"""'(?:[^'\\\n]|\\[^\n])*'|"(?:[^"\\\n]|\\[^\n])*"|`(?:[^`\\]|\\(?s:.))*`|/\*(?s:.)*?\*/|//[^\n]*|[^'"`/]+|(?s:.)"""
EXPRESSION = r"\$\{((?:[^{}`]|\{[^{}`]*\})*)\}"
SHORT_STRING = r"""(?:'[^'\n]*'|"[^"\n]*")"""
MODIFIERS = r"[ \t]*(?:export\s+)?(?:default\s+)?"
# Headers that may run over several lines, from the start of a line on.
HEADERS = (
    rf"[ \t]*import\s[0-9A-Za-z_$,*{{}} \t\r\n]*from\s*{SHORT_STRING}",
    r"[ \t]*export\s*(?:type\s+)?\{[0-9A-Za-z_$, \t\r\n]*\}",
    rf"{MODIFIERS}(?:const|let|var)\s+\{{[^'\"`;()]*?\}}\s*=\s*require\s*\(\s*{SHORT_STRING}\s*\)",
    rf"{MODIFIERS}(?:async\s+)?function\s*\*?\s*(?:{I})?(?:\s*<[^<>]*>)?\s*\({nested(4)}\)",
    rf"{MODIFIERS}(?:const|let|var)\s+{I}\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\s*\*?\s*(?:{I})?\s*)?\({nested(4)}\)",
    rf"[ \t]+(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?{I}\s*\([^()'\"`;]*\)\s*(?::[^{{;\n]*)?\{{",
)
STATEMENT = rf"(?:{'|'.join(HEADERS)})[^\n]*\n?|[^\n]*\n|[^\n]+"
NOT_CALLED = rf"(^|[^0-9A-Za-z_$])(?:function(?:{W}*\*)?|new{W})(?:{W}*[0-9A-Za-z_$.]+)?{W}*\("
METHOD_HEAD = rf"^{W}+[^(]*\("
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
PARAM_NAME = rf"^({I})(?:{W}*\?)?{W}*(?:[:=][^\n]*)?\z"
PARAM_REST = rf"^(\.\.\.){W}*({I})"
