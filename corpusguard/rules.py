"""Rule dimension of the security scan.

Everything in the two "fixed values" blocks is data that results depend on:
titles, severities, patterns and texts. The rest is a thin container that
checks the size of a rule set before it is turned into literals and a
broadcast table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_RULES = 2000

# ---------------------------------------------------------------------------
# White space as the scanned languages' tooling defines it
# (includes NBSP, the BOM and the Unicode separators), and the left boundary
# that stands in for an ASCII word boundary.
# ---------------------------------------------------------------------------
W = r"[\t-\r\p{Z}\x{FEFF}]"
LB = r"(?:^|[^0-9A-Za-z_])"
RB = r"(?:[^0-9A-Za-z_]|\z)"


@dataclass(frozen=True)
class Rule:
    """One line rule. Group 1 of ``regex`` is the reported text.

    ``stem`` lists plain words, separated by ``|``, one of which every hit contains;
    ``stem_pattern`` is a pattern every hit contains as well, ignoring case, tried
    after the words. They feed the cheap prefilter. A rule with neither switches
    the prefilter off for its languages.
    """

    rule_id: int
    title: str
    severity: str
    regex: str
    extensions: tuple[str, ...]
    stem: str = ""
    story: tuple[str, str, str] | None = None
    scenario: str = "default"
    why: str | None = None
    impact: str | None = None
    fix: str | None = None
    #: a line stops being a hit when this pattern occurs at least as often as ``regex``
    unless: str | None = None
    stem_pattern: str = ""

    @property
    def pattern(self) -> str:
        return self.regex.replace("~W~", W)

    @property
    def unless_pattern(self) -> str | None:
        return self.unless.replace("~W~", W) if self.unless else None


# ---------------------------------------------------------------------------
# File types, ignored directories, rule catalogue
# ---------------------------------------------------------------------------
JS = (".js", ".jsx", ".ts", ".tsx")
PY = (".py",)
PHP = (".php",)
C_SOURCE = (".c", ".cpp")
C_HEADER = (".h", ".hpp")
JAVA = (".java",)
CSHARP = (".cs",)

ALLOWED_EXTENSIONS = JS + PY + PHP + C_SOURCE + C_HEADER + JAVA + CSHARP
STATUS_EXTENSIONS = JS + (".mjs", ".cjs", ".mts", ".cts")
IGNORED_SEGMENTS = ("node_modules", ".git", "dist", "build", "vendor")
COMMENT_MARKERS = ("//", "#", "/*", "*", "--", "{#", "<!--")
SUPPRESSION_MARK = "scan-ignore"
SEVERITY_WEIGHTS = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}

SPECIFIC_COMMAND_MARK = "Command Injection ("
GENERIC_COMMAND_TITLES = ("JS/TS Command Injection", "Python Command Injection")
MEDIUM_TITLES = ("Hardcoded Secret",)
MEDIUM_TITLE_PARTS = ("Insecure Deserialization", "Local File Inclusion")

SUPERGLOBAL = r"\$_(?:GET|POST|REQUEST|COOKIE)"

RULES: tuple[Rule, ...] = (
    Rule(1, "Hardcoded Secret", "HIGH",
         r"""(?i)(?:^|[^0-9A-Za-z_])((?:secret|password|api[_-]?key|token|passwd|private[_-]?key)~W~*=~W~*['"`][A-Za-z0-9_\-.~+/]{8,}['"`])""",
         ALLOWED_EXTENSIONS, "=",
         ("Source Code", "Credential exposure", "Account compromise"), "default",
         "Secrets in code are exposed in version control and built artifacts.",
         "Attackers can reuse leaked credentials to access systems.",
         "Move secrets to environment variables or a secrets manager.",
         stem_pattern=r"secret|passw|api[_-]?key|token|private[_-]?key"),
    Rule(2, "JS/TS Command Injection", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])((?:exec|execSync|spawn|spawnSync)~W~*\()",
         JS, "exec|spawn",
         ("User Input", "shell execution", "Remote Shell Access"), "shell",
         "Shell execution APIs can interpret attacker-controlled strings.",
         "A crafted value can execute arbitrary server commands.",
         "Use execFile or spawn with fixed commands and argument arrays."),
    Rule(3, "JS/TS Command Injection (shell:true)", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])(spawn~W~*\([^)]*,~W~*\{[^}]*shell~W~*:~W~*true)",
         JS, "spawn",
         ("User Input", "shell:true", "Remote Shell Access"), "shell",
         "shell:true reintroduces shell parsing for spawned processes.",
         "Arguments can become command syntax.",
         "Remove shell:true and pass discrete arguments."),
    Rule(4, "JS/TS Command Injection (template literal)", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])(exec(?:Sync)?~W~*\(~W~*`[^`]*\$\{)",
         JS, "exec",
         ("User Input", "template shell command", "Remote Shell Access"), "shell",
         "Template literals embed input into shell strings.",
         "Attackers can append shell metacharacters.",
         "Use execFile with argument arrays."),
    Rule(5, "JS/TS Dynamic Evaluation", "HIGH",
         r"(?:^|[^0-9A-Za-z_])(eval~W~*\()",
         JS, "eval",
         ("User Input", "eval()", "Runtime Code Execution"), "code",
         "eval executes arbitrary strings as code.",
         "Input can become runtime code execution.",
         "Use JSON parsing or explicit dispatch maps."),
    Rule(6, "JS/TS Insecure InnerHTML", "HIGH",
         r"(\.innerHTML~W~*=)",
         JS, "innerHTML",
         ("User Input", "innerHTML", "Cross-site Scripting"), "markup",
         "innerHTML bypasses output encoding.",
         "Unsanitized content can trigger XSS.",
         "Use textContent or sanitize HTML before insertion."),
    Rule(7, "JS/TS Insecure InnerHTML (dangerouslySetInnerHTML)", "HIGH",
         r"(dangerouslySetInnerHTML~W~*=~W~*\{~W~*\{)",
         JS, "dangerouslySetInnerHTML",
         ("User Input", "dangerouslySetInnerHTML", "Cross-site Scripting"), "markup",
         "React escaping is bypassed for raw HTML.",
         "Unsanitized content can execute scripts.",
         "Sanitize with a trusted HTML sanitizer first."),
    Rule(8, "JS/TS Insecure InnerHTML (document.write)", "HIGH",
         r"""(document\.write~W~*\([^)'"`][^)]*\))""",
         JS, "document.write",
         ("User Input", "document.write()", "Cross-site Scripting"), "markup",
         "document.write injects raw markup.",
         "Attackers can run browser scripts.",
         "Use DOM APIs and text nodes instead."),
    Rule(9, "JS/TS Prototype Pollution", "HIGH",
         r"""(\[['"`]__proto__['"`]\]|constructor~W~*\[['"`]prototype['"`]\])""",
         JS, "__proto__|prototype",
         ("User Input", "__proto__ write", "Prototype Pollution"), "default",
         "Writing prototype keys changes inherited object behavior.",
         "Security checks or app logic can be bypassed globally.",
         "Block __proto__, constructor, and prototype keys before assignment."),
    Rule(10, "Python Command Injection", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])((?:os\.system|subprocess\.(?:Popen|run|call))~W~*\()",
         PY, "os.system|subprocess.",
         ("User Input", "shell execution", "Remote Shell Access"), "shell",
         "Command APIs can execute attacker-controlled strings.",
         "A crafted value can run server commands.",
         "Pass commands as lists and keep shell=False."),
    Rule(11, "Python Command Injection (shell=True)", "CRITICAL",
         r"(subprocess\.[0-9A-Za-z_]+~W~*\([^)]*shell~W~*=~W~*True)",
         PY, "subprocess.",
         ("User Input", "shell=True", "Remote Shell Access"), "shell",
         "shell=True sends the command through a shell.",
         "Metacharacters can execute extra commands.",
         "Remove shell=True and pass argument arrays."),
    Rule(12, "Python Insecure Deserialization", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])(pickle\.loads~W~*\()",
         PY, "pickle.loads",
         ("Serialized Payload", "pickle.loads()", "Remote Code Execution"), "payload",
         "pickle can execute code during loading.",
         "Malicious payloads can run arbitrary code.",
         "Use JSON or a safe typed format for untrusted data."),
    Rule(13, "Python Insecure Deserialization (PyYAML)", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])(yaml\.load~W~*\()",
         PY, "yaml.load",
         ("YAML Payload", "yaml.load()", "Remote Code Execution"), "payload",
         "yaml.load can construct unsafe Python objects.",
         "Payloads can trigger code execution.",
         "Use yaml.safe_load or SafeLoader.",
         unless=r"yaml\.load~W~*\([^)]*Loader~W~*=~W~*yaml\.SafeLoader"),
    Rule(14, "Python Dynamic Evaluation", "HIGH",
         r"(?:^|[^0-9A-Za-z_])((?:eval|exec)~W~*\()",
         PY, "eval|exec",
         ("User Input", "eval()/exec()", "Runtime Code Execution"), "shell",
         "eval and exec run strings as Python code.",
         "Input can become arbitrary execution.",
         "Use parsing, validation, and explicit operations."),
    Rule(15, "Python SQL Injection Risk", "CRITICAL",
         r"""(\.execute~W~*\(~W~*(?:f['"`]|['"`][^'\"]*%[sd]))""",
         PY, ".execute",
         ("User Input", "SQL string formatting", "Data Exposure"), "sql",
         "Formatted SQL strings mix query code and data.",
         "Attackers can alter database queries.",
         "Use parameterized queries."),
    Rule(16, "Python SSTI Risk", "HIGH",
         r"(?:^|[^0-9A-Za-z_])((?:render_template_string|Environment(?:[^0-9A-Za-z_)][^)]*)?\)\.from_string)~W~*\()",
         PY, "render_template_string|from_string",
         ("User Input", "template render", "SSTI / RCE"), "default",
         "Rendering user-controlled templates exposes template execution.",
         "Attackers can read data or execute server-side behavior.",
         "Render fixed templates with escaped variables."),
    Rule(17, "Python Path Traversal", "HIGH",
         r"(?:^|[^0-9A-Za-z_])(open~W~*\(~W~*(?:request\.|req\.|os\.path\.join~W~*\([^)]*request))",
         PY, "open",
         ("User Input", "open(path)", "File Disclosure"), "path",
         "User-controlled paths can escape intended directories.",
         "Server files can be disclosed.",
         "Normalize paths and enforce an allowlisted base directory."),
    Rule(18, "PHP Command Injection", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])((?:exec|shell_exec|system|passthru|popen)~W~*\()",
         PHP, "exec|system|passthru|popen",
         ("User Input", "shell execution", "Remote Shell Access"), "shell",
         "Shell helpers execute strings in a command context.",
         "Attackers can run OS commands.",
         "Avoid shell execution or escape arguments with strict allowlists."),
    Rule(19, "PHP SQL Injection Risk", "CRITICAL",
         r"""(?:^|[^0-9A-Za-z_])(mysqli_query~W~*\(~W~*[^,]+,~W~*['"`][^\r\n\x{2028}\x{2029}]*\$[^\r\n\x{2028}\x{2029}]*['"`]~W~*\))""",
         PHP, "mysqli_query",
         ("User Input", "SQL interpolation", "Data Exposure"), "sql",
         "Interpolated SQL mixes input and query syntax.",
         "Attackers can read or mutate data.",
         "Use prepared statements."),
    Rule(20, "PHP SQL Injection Risk (user input)", "CRITICAL",
         r"((?:query|mysqli_query)~W~*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE))",
         PHP, "query",
         ("HTTP Input", "SQL query", "Data Exposure"), "sql",
         "Superglobals reach query APIs directly.",
         "HTTP input can alter SQL.",
         "Validate input and use bound parameters."),
    Rule(21, "PHP Local File Inclusion", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])((?:include|require)(?:_once)?~W~*\(~W~*\$)",
         PHP, "include|require",
         ("User Input", "include($path)", "File Inclusion"), "path",
         "Variable include paths load attacker-selected files.",
         "Sensitive files or uploaded code can be executed.",
         "Map route names to fixed files."),
    Rule(22, "PHP Variable Injection", "HIGH",
         r"(?:^|[^0-9A-Za-z_])(extract~W~*\(~W~*\$_(?:GET|POST|REQUEST|COOKIE))",
         PHP, "extract",
         ("HTTP Input", "extract()", "Variable Overwrite"), "default",
         "extract imports request keys into local variables.",
         "Attackers can overwrite trusted values.",
         "Read explicit request fields."),
    Rule(23, "PHP Insecure Deserialization", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])(unserialize~W~*\(~W~*\$_(?:GET|POST|REQUEST|COOKIE))",
         PHP, "unserialize",
         ("User Input", "unserialize()", "Object Injection"), "payload",
         "unserialize can instantiate attacker-controlled objects.",
         "Magic methods can trigger code paths.",
         "Use JSON or allowed_classes=false."),
    Rule(24, "PHP Dynamic Evaluation", "HIGH",
         r"(?:^|[^0-9A-Za-z_])((?:eval|assert)~W~*\()",
         PHP, "eval|assert",
         ("User Input", "eval()", "Runtime Code Execution"), "code",
         "eval/assert can run strings as PHP code.",
         "Input can execute arbitrary code.",
         "Use explicit logic instead of dynamic evaluation."),
    Rule(25, "C/C++ Buffer Overflow Risk", "HIGH",
         r"(?:^|[^0-9A-Za-z_])((?:strcpy|strcat|sprintf|gets)~W~*\()",
         C_SOURCE + C_HEADER, "strcpy|strcat|sprintf|gets",
         ("Buffer Data", "unsafe copy", "Memory Corruption"), "default",
         "Unsafe copy APIs do not enforce buffer length.",
         "Memory corruption can crash or compromise the process.",
         "Use bounded APIs and validate lengths."),
    Rule(26, "C/C++ Format String", "HIGH",
         r"""(?:^|[^0-9A-Za-z_])((?:printf|fprintf|sprintf|syslog)~W~*\()(?:[^"']|$)""",
         C_SOURCE + C_HEADER, "printf|syslog",
         ("User Input", "printf(userInput)", "Memory Read/Write"), "default",
         "User input as a format string is interpreted by printf-like APIs.",
         "Attackers can read or write memory.",
         'Use fixed format strings such as "%s".'),
    Rule(27, "C/C++ Integer Overflow Risk", "MEDIUM",
         r"(?:^|[^0-9A-Za-z_])(malloc~W~*\(~W~*[0-9A-Za-z_]+~W~*\*~W~*[0-9A-Za-z_]+~W~*\))",
         C_SOURCE, "malloc",
         ("Size Input", "malloc(a*b)", "Heap Overflow"), "default",
         "Unchecked multiplication can wrap before allocation.",
         "A too-small allocation can lead to heap overflow.",
         "Check multiplication overflow before allocation."),
    Rule(28, "Java/C# Command Injection", "CRITICAL",
         r"(?:^|[^0-9A-Za-z_])((?:Runtime\.getRuntime\(\)\.exec|ProcessBuilder|Process\.Start)~W~*\()",
         JAVA + CSHARP, "getRuntime|ProcessBuilder|Process.Start",
         ("User Input", "process start", "Remote Shell Access"), "shell",
         "Process creation APIs can run external commands.",
         "Attacker input can become command execution.",
         "Use fixed commands, strict allowlists, and argument arrays."),
    Rule(29, "Java Path Traversal", "HIGH",
         r"""(?:^|[^0-9A-Za-z_])((?:new~W~+File|Paths\.get|new~W~+FileInputStream)~W~*\()(?:[^"']|$)""",
         JAVA, "File|Paths.get",
         ("User Input", "new File(path)", "File Disclosure"), "path",
         "User-controlled paths can escape expected roots.",
         "Sensitive files can be read.",
         "Normalize and verify paths remain under an allowed directory."),
    Rule(30, "Java SQL Injection Risk", "CRITICAL",
         r"""(\.execute(?:Query|Update)?~W~*\(~W~*[\"'][^\"']*[\"']~W~*\+)""",
         JAVA, ".execute",
         ("User Input", "SQL concatenation", "Data Exposure"), "sql",
         "String concatenation in SQL mixes code and data.",
         "Attackers can modify queries.",
         "Use PreparedStatement parameters."),
    Rule(31, "C# SQL Injection Risk", "CRITICAL",
         r"""(new~W~+SqlCommand~W~*\(~W~*(?:[\"'][^\"']*[\"']~W~*\+|\$[\"']))""",
         CSHARP, "SqlCommand",
         ("User Input", "SqlCommand", "Data Exposure"), "sql",
         "Concatenated SQL command text mixes code and data.",
         "Attackers can access or alter database content.",
         "Use SqlParameter values."),
    Rule(32, "C# Path Traversal", "HIGH",
         r"""(?:^|[^0-9A-Za-z_])((?:Path\.Combine|File\.Open|File\.ReadAll(?:Text|Bytes))~W~*\()(?:[^"']|$)""",
         CSHARP, "Path.Combine|File.Open|File.ReadAll",
         ("User Input", "File.Open(path)", "File Disclosure"), "path",
         "User-controlled file paths can escape safe directories.",
         "Sensitive files can be exposed.",
         "Canonicalize and enforce an allowed root."),
)

DEFAULT_STORY_HEAD = "User Input"
DEFAULT_STORY_TAIL = "Potential Impact"
DEFAULT_SOURCE = "an unvalidated input"

SCENARIOS = {
    "shell": "An attacker supplies a crafted value through {src}. That value reaches {sink} without validation, enabling attacker-controlled shell commands.",
    "code": "An attacker supplies a crafted value through {src}. The value flows into {sink}, allowing attacker-controlled code execution.",
    "markup": "An attacker supplies HTML or script through {src}. It is rendered through {sink}, enabling cross-site scripting.",
    "sql": "An attacker supplies a crafted value through {src}. It is embedded in SQL via {sink}, exposing or modifying data.",
    "payload": "An attacker supplies a malicious payload through {src}. Deserialization through {sink} can execute attacker-controlled behavior.",
    "path": "An attacker supplies a path through {src}. The application opens it through {sink}, potentially exposing server files.",
    "default": "An attacker supplies a crafted value through {src}. It reaches {sink} without validation, creating {outcome}.",
}

# Taint sources, in test order; group 1 is the label.
SOURCES = (
    LB + r"(req\.body\.[0-9A-Za-z_]+)",
    LB + r"(req\.query\.[0-9A-Za-z_]+)",
    LB + r"(req\.params\.[0-9A-Za-z_]+)",
    LB + r"(process\.env\.[0-9A-Za-z_]+)",
    LB + r"(request\.args(?:\[[^\]]+\]|\.get\([^)]+\)))",
    LB + r"(request\.form(?:\[[^\]]+\]|\.get\([^)]+\)))",
    LB + r"(request\.json(?:\[[^\]]+\])?)",
    r"(" + SUPERGLOBAL + r"\[[^\]]+\])",
    LB + r"(Request\.(?:Query|Form|Params)\[[^\]]+\])",
    LB + r"(request\.getParameter\([^)]+\))",
)

# What a hit of each of SOURCES contains, in the same order.
SOURCE_WORDS = ("req.body.", "req.query.", "req.params.", "process.env.", "request.args", "request.form", "request.json",
                "$_", "Request.", "request.getParameter(")

# Every source contains one of these.
SOURCE_STEMS = ("req.", "process.env.", "request.", "$_", "Request.")

# (pattern on the source, ignoring case; entry; evidence), in test order.
ENTRY_LADDER = (
    (r"req\.query|request\.args|request\.query", "User Input", "query parameter"),
    (r"req\.body|request\.json|request\.form", "User Input", "request body"),
    (r"req\.params|request\.params|request\.getparameter", "User Input", "route parameter"),
    (r"process\.env", "Environment Input", "environment variable"),
    (r"\$_GET", "User Input", "GET parameter"),
    (r"\$_POST", "User Input", "POST parameter"),
    (r"\$_REQUEST", "User Input", "request parameter"),
    (r"\$_COOKIE", "User Input", "cookie value"),
)

SINK = (
    r"(?i)" + LB
    + r"(subprocess\.[0-9A-Za-z_]+|dangerouslySetInnerHTML|document\.write|yaml\.load|pickle\.loads|unserialize|mysqli_query"
    + r"|new" + W + r"+SqlCommand|Path\.Combine|File\.Open|Runtime\.getRuntime\(\)\.exec|ProcessBuilder|Process\.Start"
    + r"|exec|spawn|shell_exec|system|passthru|popen|eval|assert)" + RB
)

FUNCTION_HEADER = (
    r"(?:function(?:" + W + r"*\(|[^0-9A-Za-z_{(][^{(]*\()|(?:def" + W + r"+[0-9A-Za-z_]+|void" + W
    + r"+[0-9A-Za-z_]+|public" + W + r"+[0-9A-Za-z_]+" + W + r"+[0-9A-Za-z_]+)" + W + r"*\()[^)]+\)"
)

# (substring of the module name, framework, weight), in test order.
FRAMEWORKS = (
    ("express", "Express", 0.4),
    ("react", "React", 0.4),
    ("next", "Next.js", 0.4),
    ("mongoose", "Mongoose", 0.4),
    ("axios", "Axios", 0.4),
    ("jsonwebtoken", "jsonwebtoken", 0.5),
    ("bcrypt", "bcrypt", 0.5),
    ("sequelize", "Sequelize", 0.4),
)
ROUTE_FRAMEWORK = ("Express", 0.2)
REPEAT_FACTOR = 0.6

AUTH, API, SERVICE, DATA, UI, GENERAL = (
    "Authentication Module", "API Controller", "Service Layer",
    "Data Access Layer", "UI Component", "General Utility",
)
RESPONSIBILITIES = {
    AUTH: ("User Authentication", "Session Validation"),
    DATA: ("Data Modeling", "Query Execution", "Schema Management"),
    API: ("Request Handling", "Response Formatting", "Routing"),
    SERVICE: ("Business Logic", "Orchestration", "Error Handling"),
    UI: ("UI Rendering", "State Management", "Event Handling"),
    GENERAL: ("Helper Functions", "Shared Logic"),
}
# --------------------------- end of fixed values ---------------------------


def severity_table(spark: SparkSession) -> DataFrame:
    """The four severities and their weights."""
    return spark.createDataFrame(pa.table({
        "severity": list(SEVERITY_WEIGHTS),
        "weight": pa.array(list(SEVERITY_WEIGHTS.values()), pa.int32()),
    }))


@dataclass(frozen=True)
class RuleSet:
    """An ordered, size-checked list of rules."""

    rules: tuple[Rule, ...] = field(default=RULES)

    def __post_init__(self) -> None:
        if len(self.rules) > MAX_RULES:
            raise ValueError(f"{len(self.rules)} rules, at most {MAX_RULES} can be unrolled into a scan")
        ids = [r.rule_id for r in self.rules]
        if len(set(ids)) != len(ids):
            raise ValueError("rule ids must be distinct")

    @classmethod
    def from_dataframe(cls, df: DataFrame, base: RuleSet | None = None) -> RuleSet:
        """Add the rows of a user rule table to ``base``.

        Needed columns: rule_id, title, severity, regex, extensions (array).
        Optional: unless, stem, stem_pattern, story (array of 3), scenario, why, impact, fix.
        The table is a dimension, so its size is checked before it is read.
        """
        wanted = ("rule_id", "title", "severity", "regex", "extensions", "unless",
                  "stem", "stem_pattern", "story", "scenario", "why", "impact", "fix")
        have = [c for c in wanted if c in df.columns]
        rows = df.select(*have).orderBy("rule_id").limit(MAX_RULES + 1).collect()
        added = []
        for row in rows:
            values = row.asDict()
            values["extensions"] = tuple(values["extensions"])
            if values.get("story"):
                values["story"] = tuple(values["story"])
            added.append(Rule(**{k: v for k, v in values.items() if v is not None}))
        return cls((base or cls()).rules + tuple(added))

    @property
    def extensions(self) -> list[str]:
        return list(dict.fromkeys(e for r in self.rules for e in r.extensions))

    def groups(self) -> list[tuple[tuple[str, ...], tuple[Rule, ...]]]:
        """Extensions that share the same rules, with those rules in order."""
        by_rules: dict[tuple[Rule, ...], list[str]] = {}
        for ext in self.extensions:
            by_rules.setdefault(tuple(r for r in self.rules if ext in r.extensions), []).append(ext)
        return [(tuple(exts), rules) for rules, exts in by_rules.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        """The rule dimension, at most MAX_RULES rows."""
        stories = [self._story(r) for r in self.rules]
        scenarios = [
            SCENARIOS[r.scenario].replace("{sink}", s[1]).replace("{outcome}", s[2].lower())
            for r, s in zip(self.rules, stories)
        ]
        return spark.createDataFrame(pa.table({
            "rule_id": pa.array([r.rule_id for r in self.rules], pa.int32()),
            "rule_ord": pa.array(range(1, len(self.rules) + 1), pa.int32()),
            "title": [r.title for r in self.rules],
            "severity": [r.severity for r in self.rules],
            "weight": pa.array([SEVERITY_WEIGHTS[r.severity] for r in self.rules], pa.int32()),
            "story": pa.array(stories, pa.list_(pa.string())),
            "scenario_template": scenarios,
            "why": pa.array([r.why for r in self.rules], pa.string()),
            "impact": pa.array([r.impact for r in self.rules], pa.string()),
            "fix": pa.array([r.fix for r in self.rules], pa.string()),
        }))

    def extension_table(self, spark: SparkSession) -> DataFrame:
        """The bridge (file_type, rule_id)."""
        pairs = [(e, r.rule_id) for r in self.rules for e in r.extensions]
        return spark.createDataFrame(pa.table({
            "file_type": [p[0] for p in pairs],
            "rule_id": pa.array([p[1] for p in pairs], pa.int32()),
        }))

    @staticmethod
    def _story(rule: Rule) -> list[str]:
        return list(rule.story or (DEFAULT_STORY_HEAD, rule.title, DEFAULT_STORY_TAIL))

    def with_rule(self, rule: Rule) -> RuleSet:
        return replace(self, rules=self.rules + (rule,))


def register_rules(df: DataFrame, base: RuleSet | None = None) -> RuleSet:
    """Public entry point for user rule tables."""
    return RuleSet.from_dataframe(df, base)
