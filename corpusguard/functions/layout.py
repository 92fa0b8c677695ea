"""One statement per row: JavaScript and TypeScript texts laid out by their matched brackets.

Matching brackets of any depth takes a stack, which column functions lack, so this one
step is Python, fed with Arrow batches in the scan's own stage: no shuffle, one pass per
file, linear in its length. It finds no names; patterns over the rows do.

Comments go, templates without expressions are strings and others the list of their
expressions. A row ends at a line's end, after the brace that opens the body of a function,
class or object with functions, before the one that closes it, after the comma between
members or declared variables (which get the keyword of their statement again), and
before a declaration that follows a semicolon. Headers, imports, export lists and the
values of arrow functions are never cut, however many lines they take.

Long stretches of words and stops within a line, as in prose, are one token. So are the lines of
prose that end a text. A search for the bounds of a header or a value that would have to look into one starts over without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\\n]|\\[^\n])*+'|"(?:[^"\\\n]|\\[^\n])*+")|(?P<line>\n)|(?P<word>[A-Za-z_$][0-9A-Za-z_$]*+)"""
    r"""|(?P<mark>=>|[(){}\[\];,:=<>@.`/])|(?P<space>[^\S\n]++)|(?P<other>[^\s'"`/(){}\[\];,:=<>@.A-Za-z_$]++|.)""", re.S)
#: The tokens of a line that has no comment, template or pattern: no slash and no backtick but inside strings.
PLAIN = re.compile(
    r"""'(?:[^'\\\n]|\\[^\n])*+'|"(?:[^"\\\n]|\\[^\n])*+"|\n|[A-Za-z_$][0-9A-Za-z_$]*+"""
    r"""|=>|[(){}\[\];,:=<>@.`/]|[^\S\n]++|[^\s'"`/(){}\[\];,:=<>@.A-Za-z_$]++|.""", re.S)
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)
PLAIN_TEMPLATE = re.compile(r"`(?:[^`\\]|\\.)*+`", re.S)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*")
STRUCTURAL = re.compile(r"\s*(?:import|export|abstract|class|const|let|var)(?![0-9A-Za-z_$])|.*[(){}]", re.S)
GENERIC = re.compile(r"<[^<>]*>")
DECORATOR = re.compile(r"@[0-9A-Za-z_$.]+\s*")
OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Marks that neither open, close nor part anything.
PASSIVE = frozenset(". : = < > @ =>".split())
#: Tokens of a header, and of the value of an arrow function.
HEADER, VALUE = 1, 2
#: Braces around a body, and around something that holds bodies.
BODY, HOLDER = 1, 2
#: Stand for nested braces, brackets and arrows in ``head``.
BRACES, BRACKETS, ARROW = "\x01", "\x02", "\x04"

CONTROL = frozenset("if for while switch catch with".split())
BEFORE_BLOCK = frozenset("else do try finally static".split())
MODIFIERS = frozenset("function * async static get set public private protected readonly override export default abstract declare".split())
DECLARING = frozenset("const let var".split())
CONTINUES_BLOCK = frozenset("else catch finally while from as instanceof in of extends implements".split())
STARTS = frozenset("function async class const let var import export abstract".split())
#: Words that are not part of a type.
NO_TYPE = frozenset("function async const let var import export return if else for while do new throw await yield case default".split())
NO_VALUE = frozenset("const let var import export return".split())
WITHIN_TYPE = frozenset(", | & < ( : => . extends implements".split())
NAMED_BODY = frozenset("class interface enum namespace module".split())
#: A line that ends with, or is followed by, one of these goes on.
GOES_ON = frozenset(", = => + - * / & | ? : < > ( [ { . ! && || ?? ?.".split())
#: Words that mean something wherever they stand; they are never part of a stretch of prose.
KEYS = MODIFIERS | DECLARING | STARTS | NO_VALUE | NAMED_BODY | frozenset("require extends implements".split())
WORD = re.compile(r"[A-Za-z_$][0-9A-Za-z_$]*+")
#: All ASCII characters but letters and the two signs of a word, as blanks.
GAPS = {c: " " for c in range(128) if not (chr(c).isalpha() or chr(c) in "_$")}
STRETCH = re.compile(r"""[^\n'"`/(){}\[\]:;=<>@]*+""")
LONG = 48
KEPT = 256      # lines below this length may be kept, so that equal ones are cut into tokens once
LONG_STRETCH = re.compile(rf"""[^\n'"`/(){{}}\[\]:;=<>@]{{{LONG}}}""")
BOUNDS = "'\"`/(){}[]:;=<>@"
WHERE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || return typeof case in of do else".split())


class _Kinds(dict):
    """The kind of a token of ``PLAIN`` by its first character; a quote that stands alone is another."""

    def __missing__(self, c: str) -> str:
        if c in "(){}[];,:=<>@.":
            kind = "mark"
        elif c == "'" or c == '"':
            kind = "string"
        elif c == "\n":
            kind = "line"
        elif c.isspace():
            kind = "space"
        else:
            kind = "word" if WORD.match(c) else "other"
        self[c] = kind
        return kind


KINDS = _Kinds()


class Row(NamedTuple):
    line_no: int
    place: int
    level: int      # bodies open around the row
    shut: bool      # starts with the brace that closes a body
    opens: bool     # ends with the brace that opens one
    line: str
    head: str       # strings emptied, and what is nested inside the first bracket level reduced to marks


@lru_cache(maxsize=4096)
def _plain_line(text: str) -> tuple[list[str], list[str], str] | None:
    """Kinds and words of the tokens of a line and the last that is no space, or nothing if it may hold a comment, template or pattern."""
    found = PLAIN.findall(text)
    if "/" in found or "`" in found:
        return None
    kinds = [KINDS[t[0]] for t in found]
    if "'" in found or '"' in found:
        kinds = ["other" if t == "'" or t == '"' else k for k, t in zip(kinds, found)]
    return kinds, found, next((t for k, t in zip(reversed(kinds), reversed(found)) if k != "space" and k != "line"), "")


def _has_keys(text: str) -> bool:
    """Whether any word is one of KEYS; parts of words beside digits may be taken for one."""
    return not KEYS.isdisjoint(text.translate(GAPS).split() if text.isascii() else WORD.findall(text))


class _Entered(Exception):
    """A search came to a token of kind ``prose``, whose words it would have to see."""


def _prose_end(text: str, start: int) -> int:
    """Where prose behind the words that end at ``start`` ends, or ``start``. Its last two words and what follows them stay tokens."""
    stretch = STRETCH.match(text, start)[0]
    if len(stretch) < LONG:
        return start
    if _has_keys(stretch):
        stretch = stretch[:next((m.start() for m in WORD.finditer(stretch) if m[0] in KEYS), len(stretch))]
    body, *tail = stretch.rsplit(" ", 3)
    # a blank before the tail would be cut from its neighbours
    if len(tail) < 3 or len(body) < LONG // 2 or body[-1].isspace() or len(WORD.findall(" ".join(tail))) < 2:
        return start
    return start + len(body)


def _tail(text: str) -> int:
    """Where whole lines of prose begin that last to the end of the text, one line behind the last that may bound anything."""
    last = max(map(text.rfind, BOUNDS))
    start = text.find("\n", text.find("\n", last + 1) + 1) + 1 if "\n" in text[last + 1:] else 0
    if not start or len(text) - start < LONG or _has_keys(text[start:]):
        return len(text)
    return start


class _Text:
    """The tokens of a text, without comments and space in ``index``, with matched brackets."""

    def __init__(self, text: str, prose: bool = True):
        self.prose = prose
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        #: tokens that may not be cut: those inside templates
        self.inner: list[bool] = []
        self._read(text)
        self.index: list[int] = []
        self.before: list[int] = []
        last = -1
        for i, k in enumerate(self.kind):
            self.before.append(last)
            if k != "space" and k != "line":
                self.index.append(i)
                last = i
        self._match()

    def _read(self, text: str) -> None:
        kind, words, lines, inner = self.kind, self.text, self.line, self.inner
        at, number, n = 0, 1, _tail(text) if self.prose else len(text)
        templates: list[int] = []  # open braces inside the expression of each open template
        closable = True
        previous = ""
        words_on = 0    # words since any mark but a stop
        tried = 0       # no stretch starts before this place

        def put(k: str, t: str) -> None:
            kind.append(k)
            words.append(t)
            lines.append(number)
            inner.append(bool(templates))

        def template(start: int) -> int:
            """Read template text up to its end or its next expression."""
            nonlocal number
            end = TEMPLATE.match(text, start).end()
            number += text.count("\n", start, end)
            if text.startswith("${", end):
                return end + 2
            templates.pop()
            put("mark", ")")
            return end + 1

        read = TOKEN.match
        apart = 0       # lines up to here are read token by token
        while at < n:
            if at >= apart and not templates:
                apart = text.find("\n", at, n) + 1 or n
                if not self.prose or apart - at < LONG or not LONG_STRETCH.search(text, at, apart):
                    found = (_plain_line if apart - at < KEPT else _plain_line.__wrapped__)(text[at:apart])
                    if found:
                        kind += found[0]
                        words += found[1]
                        lines += [number] * len(found[0])
                        inner += [False] * len(found[0])
                        previous = found[2] or previous
                        number += found[0][-1] == "line"
                        words_on, at = 0, apart
                        continue
            found = read(text, at)
            k, t, end = found.lastgroup, found[0], found.end()
            if k == "space" or k == "word":
                kind.append(k)
                words.append(t)
                lines.append(number)
                inner.append(bool(templates))
                at = end
                if k == "word":
                    previous = t
                    words_on += 1
                    if words_on > 1 and end >= tried and self.prose and t not in KEYS:
                        at = _prose_end(text, end)
                        if at > end:
                            put("prose", text[end:at])
                            previous, words_on = ".", 0
                        tried = max(at, end + LONG // 2)
                continue
            if k == "mark":
                if t == "`":
                    whole = PLAIN_TEMPLATE.match(text, at) if closable else None
                    if whole is None:
                        closable = False
                        k = "other"
                    elif "${" not in whole[0]:
                        put("string", whole[0] if "\n" not in whole[0] else "``")
                        number += whole[0].count("\n")
                        previous, at = "``", whole.end()
                        continue
                    else:
                        templates.append(0)
                        put("mark", "(")
                        templates[-1] = 0
                        previous, at = "(", template(end)
                        continue
                elif t == "/":
                    value = REGEX.match(text, at) if not previous or previous in WHERE_REGEX else None
                    if value:
                        put("string", "''")
                        previous, at = "''", value.end()
                        continue
                    k = "other"
                elif templates and t == "{":
                    templates[-1] += 1
                elif templates and t == "}":
                    if not templates[-1]:
                        put("other", " + ")
                        previous, at = "+", template(end)
                        if words[-1] == ")" and words[-2] == " + ":  # the end: no expression follows
                            kind[-2], words[-2] = "space", ""
                        continue
                    templates[-1] -= 1
            if k == "comment":
                if t[1] == "*":
                    put("space", " ")
                    for _ in range(t.count("\n")):
                        put("line", "\n")
                        number += 1
            else:
                put(k, t)
                if k == "line":
                    number += 1
                    words_on = 0
                else:
                    previous = t
                    if k != "other" and t != ".":
                        words_on = 0
            at = end
        if n < len(text):
            if at > n or templates:
                raise _Entered
            put("prose", text[n:])

    def _match(self) -> None:
        n = len(self.kind)
        self.partner = [-1] * n
        #: the matched brace, and the matched bracket of any kind, around each token
        stack: list[int] = []
        held = {"(": 0, "[": 0, "{": 0}
        for i in range(n):
            if self.kind[i] != "mark":
                continue
            t = self.text[i]
            if t in OPENING:
                stack.append(i)
                held[t] += 1
            elif t in CLOSING and held[CLOSING[t]]:
                if t == "}":
                    while self.text[stack[-1]] != "{":
                        held[self.text[stack.pop()]] -= 1
                if self.text[stack[-1]] == CLOSING[t]:
                    o = stack.pop()
                    held[self.text[o]] -= 1
                    self.partner[o], self.partner[i] = i, o

    def is_word(self, i: int) -> bool:
        return i >= 0 and self.kind[i] == "word"

    def word(self, i: int) -> str:
        return self.text[i] if i >= 0 else ""


class _Layout:
    def __init__(self, text: str, prose: bool = True):
        self.t = _Text(text, prose)
        n = len(self.t.kind)
        #: lines' ends that do not end a row
        self.joined = bytearray(n + 1)
        #: braces whose insides are rows of their own
        self.split = bytearray(n)
        self._bodies()

    def _join(self, first: int, last: int, mark: int = HEADER) -> None:
        self.joined[first:last + 1] = bytes((mark,)) * max(0, last + 1 - first)

    def _seen(self, i: int) -> str:
        """The text of a token that a search comes to."""
        if self.t.kind[i] == "prose":
            raise _Entered
        return self.t.text[i]

    def _whole_at(self, i: int, around: list[int]) -> bool:
        """Whether token ``i`` does not end a row. A value is cut inside braces of its own that hold bodies, a header never."""
        mark = self.joined[i]
        return mark == HEADER or mark == VALUE and not (around and self.split[around[-1]] and self.joined[around[-1]] == VALUE)

    def _after_type(self, i: int) -> int:
        """If a type annotation ends before token ``i``, the token before its colon, else -1; also a word that names the body."""
        t, k, after = self.t, self.t.before[i], i
        while k >= 0:
            w = self._seen(k)
            if w == ":":
                return t.before[k]
            if w in ("}", "]", ")") and t.kind[after] == "word" and after != i:
                return -1
            if t.line[k] != t.line[after] and after != i and w not in WITHIN_TYPE and t.text[after] not in WITHIN_TYPE or w in NO_TYPE:
                return -1
            after = k
            if t.kind[k] == "word" and w in NAMED_BODY:
                return k
            if w in ("]", "}") and t.partner[k] >= 0:
                k = t.before[t.partner[k]]
            elif t.kind[k] in ("word", "string", "other") or w in (".", "<", ">", ",", "=>", "[", ")") and (w != ")" or t.partner[k] >= 0):
                k = t.before[t.partner[k]] if w == ")" else t.before[k]
            else:
                return -1
        return -1

    def _start(self, k: int) -> tuple[int, bool]:
        """The first token of the declaration whose function starts at ``k``, and whether that is the value of a declared variable."""
        t, value = self.t, False
        while True:
            p = t.before[k]
            if p < 0:
                return k, value
            if t.text[p] in MODIFIERS and (t.text[p] != "*" or t.word(t.before[p]) in MODIFIERS | {"{", "}", ";", ","}):
                k = p
            elif t.text[p] == "=" and t.kind[p] == "mark" and not value:
                q, name = t.before[p], -1
                while q >= 0 and not (t.kind[q] == "word" and t.text[q] in DECLARING):
                    w = self._seen(q)
                    if w == "," and name >= 0 and t.before[p] == name:
                        return name, True
                    if w in (";", "{", "(", "=") or w == "}" and t.partner[q] < 0:
                        return k, False
                    name = q if t.kind[q] == "word" else name
                    q = t.before[t.partner[q]] if w in CLOSING and t.partner[q] >= 0 else t.before[q]
                if q < 0 or t.line[q] + 64 < t.line[p]:
                    return k, False
                k, value = q, True
            else:
                return k, value

    def _header(self, o: int) -> tuple[int, bool]:
        """The first token of the function whose parameters open at ``o``, and whether it is one; a control word's are none."""
        t = self.t
        k = t.before[o]
        if k >= 0 and t.text[k] == ">":  # type parameters
            deep = 0
            while k >= 0:
                w = self._seen(k)
                deep += (w == ">") - (w == "<")
                if w in (";", "{", "}"):
                    return o, False
                k = t.before[k]
                if not deep:
                    break
        if t.is_word(k):
            if t.text[k] in CONTROL or t.text[k] == "await" and t.word(t.before[k]) == "for":
                return o, False
            return self._start(k)[0], True
        if k >= 0 and t.text[k] == "*" and t.word(t.before[k]) == "function":
            return self._start(t.before[k])[0], True
        if k >= 0 and (t.text[k] == "]" or t.kind[k] == "string"):  # computed and quoted names
            return o, True
        return self._start(o)[0], k < 0 or t.text[k] in ("=", "(", ",", ":", "?", "return")

    def _bodies(self) -> None:
        t = self.t
        braces: list[int] = []
        for i in t.index:
            w = t.text[i]
            if w == "}" and braces and t.partner[i] == braces[-1]:
                braces.pop()
            if t.kind[i] == "word":
                if w in ("import", "export"):
                    self._listed(i)
                elif w == "require":
                    self._required(i)
                elif w == "function":
                    self._declared(i)
                continue
            if t.kind[i] != "mark" or t.inner[i]:
                continue
            if w == "=>":
                self._arrow(i)
            elif w == "{" and t.partner[i] >= 0:
                braces.append(i)
                if self._opens_body(i):
                    self.split[i] = BODY
                    self._join(i + 1, t.partner[i], 0)
                    k = len(braces) - 2
                    while k >= 0 and not self.split[braces[k]]:
                        self.split[braces[k]] = HOLDER
                        k -= 1

    def _declared(self, i: int) -> None:
        """A function's keyword up to the end of its parameters."""
        t, k, steps = self.t, i + 1, 0
        while k < len(t.kind) and self._seen(k) != "(" and steps < 64:
            if t.kind[k] == "mark" and t.text[k] not in ("<", ">", ",", ".", "="):
                return
            k += 1
            steps += 1
        if k < len(t.kind) and t.partner[k] >= 0:
            self._join(self._start(i)[0], t.partner[k])

    def _arrow(self, i: int) -> None:
        """The parameters of an arrow function, and its value if that is no block."""
        t = self.t
        p = t.before[i]
        if p < 0:
            return
        if t.text[p] in (">", "]", "}") or t.is_word(p) and t.word(t.before[p]) in (":", ".", "|", "&"):
            typed = self._after_type(i)
            p = typed if typed >= 0 else p
        o = t.partner[p] if t.text[p] == ")" else p
        if o < 0:
            return
        first, value = self._start(o)
        self._join(first, i)
        self._whole(o)
        following = i + 1
        while following < len(t.kind) and t.kind[following] in ("space", "line"):
            following += 1
        if following < len(t.kind) and t.text[following] == "{":
            self._join(i, following)
        elif value:
            self._join(i + 1, self._value_end(following), VALUE)

    def _value_end(self, k: int) -> int:
        """The last token of the expression that starts at ``k``; a body inside ends the row anyway."""
        t, last = self.t, k
        while k < len(t.kind):
            w = self._seen(k)
            if t.kind[k] == "line" and not t.inner[k]:
                ahead = k + 1
                while ahead < len(t.kind) and t.kind[ahead] in ("space", "line"):
                    ahead += 1
                if ahead >= len(t.kind) or not (t.text[last] in GOES_ON or t.text[ahead] in GOES_ON - {"(", "[", "{", "!"}):
                    break
            elif t.kind[k] == "mark" and (w in (";", ",") or w in CLOSING) or t.kind[k] == "word" and w in NO_VALUE:
                break
            elif t.kind[k] == "mark" and w in OPENING and t.partner[k] >= 0:
                k = last = t.partner[k]
            elif t.kind[k] != "space":
                last = k
            k += 1
        return last

    def _listed(self, i: int) -> None:
        """An import up to its source, or the braces and the source of an export list."""
        t, k, steps = self.t, i, 0
        while k + 1 < len(t.kind):
            k += 1
            w = self._seen(k)
            if t.kind[k] in ("space", "line") or t.kind[k] == "word" and w in ("type", "from", "as"):
                continue
            if t.kind[k] == "string":
                self._join(i, k)
                return
            if w == "{" and t.partner[k] >= 0:
                k = t.partner[k]
                self._join(i, k)
                if t.text[i] == "export":
                    return
            elif t.text[i] == "export" and w != "*" or not (t.kind[k] == "word" or w in (",", "*")) or w in STARTS:
                return
            steps += 1
            if steps > 16:
                return

    def _required(self, i: int) -> None:
        """const { … } = require('…'), from its keyword on."""
        t = self.t
        p = t.before[i]
        if p >= 0 and t.text[p] == "=":
            first, value = self._start(i)
            if value:
                self._join(first, i)

    def _opens_body(self, i: int) -> bool:
        t = self.t
        p = t.before[i]
        if p < 0:
            return False
        w = t.text[p]
        if w == "=>":
            return True
        if w != ")":
            if t.kind[p] not in ("word", "string") and w not in (">", "]", "}"):
                return False
            p = self._after_type(i)
            if p >= 0 and t.text[p] in NAMED_BODY and t.kind[p] == "word":
                self._join(self._start(p)[0], i)
                return t.text[p] == "class"
            if p < 0 or t.text[p] != ")":
                return False
        o = t.partner[p]
        if o < 0:
            return False
        named = self._class_of(o)
        if named >= 0:
            self._join(self._start(named)[0], i)
            return True
        first, function = self._header(o)
        if function:
            self._join(first, i)
            self._whole(o)
        return function

    def _whole(self, o: int) -> None:
        """Bodies within the parameters that open at ``o`` stay in the header's row."""
        if self.t.partner[o] > o:
            self.split[o:self.t.partner[o]] = bytes(self.t.partner[o] - o)

    def _class_of(self, o: int) -> int:
        """The class keyword if the bracket is a call in a class header, as in ``class A extends mix(B) {``, else -1."""
        t, k, extended = self.t, self.t.before[o], False
        while k >= 0:
            w = self._seen(k)
            if extended and w == "class":
                return k
            if w == "extends":
                extended = True
            elif not (t.kind[k] == "word" and w not in NO_TYPE or w == "." or extended and w in ("<", ">", ",")):
                return -1
            k = t.before[k]
        return -1

    def rows(self) -> Iterator[Row]:
        t = self.t
        n = len(t.kind)
        place = level = 0
        line: list[str] = []
        number, shut, fresh = 1, False, True
        around: list[int] = []      # matched brackets around the token
        prefix, holder = "", -2     # keyword of declared variables, and the bracket their commas stand in
        started = -1

        def row(opens: bool):
            nonlocal line, place, shut, fresh, started
            text = "".join(line)
            out = None
            if shut or opens or STRUCTURAL.match(text):
                out = Row(number, place, level, shut, opens, text, _head(of_kind, line, text))
            place += 1
            line, shut, fresh, started = [], False, True, -1
            of_kind.clear()
            return out

        of_kind: list[str] = []     # the kinds of the tokens in line

        def add(k: str, w: str, i: int) -> None:
            nonlocal fresh, number, started
            if fresh and k != "space":
                number, fresh, started = t.line[i], False, i
            line.append(w)
            of_kind.append(k)

        kinds, texts, joined = t.kind, t.text, self.joined
        for i in range(n):
            k, w = kinds[i], texts[i]
            if k == "space" and not joined[i] or k == "word" and w not in DECLARING or k == "other" or k == "string" or k == "mark" and w in PASSIVE:
                if fresh and k != "space":
                    number, fresh, started = t.line[i], False, i
                line.append(w)
                of_kind.append(k)
                continue
            if k == "line":
                if self._whole_at(i, around) or t.inner[i]:
                    if line and line[-1] != " ":
                        add("space", " ", i)
                    continue
                done = row(False)
                if done:
                    yield done
                if prefix and holder == (around[-1] if around else -1):
                    ahead = i + 1
                    while ahead < n and t.kind[ahead] in ("space", "line"):
                        ahead += 1
                    if not (t.word(t.before[i]) in GOES_ON or (ahead < n and t.text[ahead] in GOES_ON - {"(", "[", "{", "!"})):
                        prefix, holder = "", -2
                    elif t.word(t.before[i]) == ",":
                        add("space", prefix, i + 1)
                        fresh = True
                continue
            if k == "space" and self._whole_at(i, around) and line and line[-1].endswith(" "):
                continue
            if k == "mark":
                if w in CLOSING and t.partner[i] >= 0:
                    if around and around[-1] == t.partner[i]:
                        around.pop()
                    if self.split[t.partner[i]]:
                        if "".join(line).strip():
                            done = row(False)
                            if done:
                                yield done
                        line.clear()
                        of_kind.clear()
                        level -= 1
                        shut = True
                        if holder == t.partner[i]:
                            prefix, holder = "", -2
                        add(k, w, i)
                        ahead = i + 1
                        while ahead < n and t.kind[ahead] == "space":
                            ahead += 1
                        if ahead < n and (t.kind[ahead] == "word" and t.text[ahead] not in CONTINUES_BLOCK or t.text[ahead] in ("}", "@", "*")):
                            yield row(False)
                            if around and self.split[around[-1]]:
                                add("space", " ", i)
                        continue
                elif w in OPENING and t.partner[i] >= 0:
                    around.append(i)
                    if self.split[i]:
                        add(k, w, i)
                        yield row(True)
                        level += 1
                        add("space", " ", i)
                        continue
                elif w == "," and not t.inner[i] and not self._whole_at(i, around):
                    inside = around[-1] if around else -1
                    if prefix and holder == inside:
                        add(k, w, i)
                        if self._same_line(i) and self._declarator(i):
                            done = row(False)
                            if done:
                                yield done
                            add("space", prefix, i)
                            fresh = True
                        continue
                    if inside >= 0 and self.split[inside] == HOLDER and self._same_line(i):
                        add(k, w, i)
                        done = row(False)
                        if done:
                            yield done
                        add("space", " ", i)
                        continue
                elif w == ";" and not t.inner[i] and not self._whole_at(i, around):
                    inside = around[-1] if around else -1
                    if prefix and holder == inside:
                        prefix, holder = "", -2
                    if inside < 0 or t.text[inside] == "{":
                        ahead = i + 1
                        while ahead < n and t.kind[ahead] == "space":
                            ahead += 1
                        ended = t.before[i] >= 0 and self.joined[t.before[i]] and self._same_line(i)
                        if ended or ahead < n and (t.text[ahead] in STARTS or (inside >= 0 and self.split[inside] and self._member(ahead))):
                            add(k, w, i)
                            done = row(False)
                            if done:
                                yield done
                            if inside >= 0 and self.split[inside]:
                                add("space", " ", i)
                            continue
            elif k == "prose":
                inside = around[-1] if around else -1
                cut = prefix and holder == inside or inside >= 0 and self.split[inside] == HOLDER
                if "\n" in w and (prefix or "".join(line).strip()):
                    raise _Entered
                if cut and "," in w and not t.inner[i] and not self._whole_at(i, around):
                    raise _Entered
            elif k == "word" and w in DECLARING and (fresh or started >= 0 and t.text[started] in ("export", "declare") and t.before[i] == started):
                inside = around[-1] if around else -1
                if inside < 0 or t.text[inside] == "{":
                    exported = not fresh and t.text[started] == "export"
                    prefix, holder = ("export " if exported else "") + w + " ", inside
            add(k, w, i)
            if k == "mark" and w == ")" and self._decorator(started, i):
                done = row(False)
                if done:
                    yield done
                add("space", " ", i)
        done = row(False)
        if done:
            yield done

    def _same_line(self, i: int) -> bool:
        """Whether more than space follows on the line."""
        t, k = self.t, i + 1
        while k < len(t.kind) and t.kind[k] == "space":
            k += 1
        return k < len(t.kind) and t.kind[k] != "line"

    def _declarator(self, i: int) -> bool:
        """Whether another declared variable follows the comma, and not the rest of a type."""
        t, k = self.t, i + 1
        while k < len(t.kind) and t.kind[k] in ("space", "line"):
            k += 1
        if k < len(t.kind) and t.text[k] in ("{", "[") and t.partner[k] >= 0:
            k = t.partner[k]
        elif k >= len(t.kind) or t.kind[k] != "word":
            return False
        k += 1
        while k < len(t.kind) and t.kind[k] == "space":
            k += 1
        return k >= len(t.kind) or t.kind[k] == "line" or t.text[k] in ("=", ":", ",", ";", "!")

    def _member(self, i: int) -> bool:
        """Whether a method header starts at ``i``, in the body of a class."""
        t, k, steps = self.t, i, 0
        while k < len(t.kind) and (t.kind[k] in ("word", "space") or self._seen(k) == "*") and steps < 16:
            k += 1
            steps += 1
        return k < len(t.kind) and t.text[k] == "(" and t.partner[k] >= 0 and bool(self.joined[t.partner[k]]) and t.text[i] not in CONTROL

    def _decorator(self, started: int, i: int) -> bool:
        """Whether the row so far is a decorator with its arguments."""
        t = self.t
        if started < 0 or t.text[started] != "@" or t.partner[i] < 0 or not self._same_line(i):
            return False
        k = t.before[t.partner[i]]
        while k > started and (t.kind[k] == "word" or self._seen(k) == "."):
            k = t.before[k]
        return k == started


def _head(kinds: list[str], words: list[str], text: str) -> str:
    """The head of the row of these tokens, whose words make up ``text``."""
    if "=>" not in words and words.count("(") + words.count("[") + words.count("{") < 2:
        # nothing is nested
        head = "".join("''" if k == "string" else w for k, w in zip(kinds, words)) if "string" in kinds else text
    else:
        out, depth = [], 0
        for k, w in zip(kinds, words):
            if k == "mark" and w in OPENING:
                if not depth:
                    out.append(w)
                elif depth == 1:
                    out.append(BRACES if w == "{" else BRACKETS if w == "[" else "")
                depth += 1
            elif k == "mark" and w in CLOSING:
                depth = max(0, depth - 1)
                if not depth:
                    out.append(w)
            elif depth < 2:
                out.append("''" if k == "string" else ARROW if depth and w == "=>" else w)
        head = "".join(out)
    generics = "<" in head
    while generics:
        head, generics = GENERIC.subn("", head)
    return DECORATOR.sub("", head) if "@" in head else head


def statements(text: str | None) -> list[Row]:
    """The rows of a text that can carry structure or bound a body."""
    if not text:
        return []
    try:
        return list(_Layout(text).rows())
    except _Entered:
        return list(_Layout(text, prose=False).rows())
