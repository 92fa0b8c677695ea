"""The innermost class and function around each statement of a file, along its rows in order.

``layout`` makes the rows of a file one behind the other, so their scopes are told there
and then: one pass, no shuffle, no sort. Only rows that open a body are read, by the
patterns of ``lexical`` that the JVM reads them by as well; all other fields stay there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

from corpusguard.functions import lexical as L
from corpusguard.functions.layout import Row, statements
from corpusguard.rules import W

FIELDS = [("line_no", pa.int32()), ("place", pa.int32()), ("level", pa.int32()), ("shut", pa.bool_()), ("opens", pa.bool_()),
          ("line", pa.string()), ("head", pa.string()), ("class_name", pa.string()), ("inside", pa.string())]
#: W with the members of its category spelled out.
WHITE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(W, WHITE).replace(r"\z", r"\Z"))


FUNCTIONS = [(_compiled(p), group, word) for p, group, word in (
    (L.DECLARATION, 4, "function"), (L.ARROW, 2, "=>"), (L.FUNCTION_VALUE, 2, "function"))]
METHOD, CLASS = _compiled(L.METHOD), _compiled(L.CLASS)


def _names(head: str) -> tuple[str | None, str | None, str | None]:
    """The function, method and class whose header this is."""
    function = method = cls = None
    for pattern, group, word in FUNCTIONS:
        if word in head:
            found = pattern.match(head)
            if found:
                function = found[group]
                break
    if "(" in head:
        found = METHOD.match(head)
        if found and found[2] not in L.NOT_A_METHOD:
            method = found[2]
    if "class" in head:
        found = CLASS.match(head)
        if found and found[3] not in L.NOT_A_NAME:
            cls = found[3]
    return function, method, cls


def around(rows: Iterable[Row]) -> Iterator[tuple[str | None, str | None]]:
    """For each row of a file the class and the function whose body it is in; the latter is empty for a class's own rows.

    A row that opens a scope has it behind itself, and the row that shuts the same body
    closes it. Bodies of one level alternate between both, so a shutting row's opener is
    the last one of its level.
    """
    classes: list[str] = []
    inner: list[str] = []
    last: dict[int, tuple[bool, bool]] = {}     # of each level: whether its last opener opened a class, and any scope
    for r in rows:
        if r.shut:
            of_class, of_any = last.get(r.level, (False, False))
            if of_class:
                classes.pop()
            if of_any:
                inner.pop()
            last[r.level] = False, False
        class_name = classes[-1] if classes else None
        yield class_name, inner[-1] if inner else None
        if r.opens:
            function, method, cls = _names(r.head)
            own = function
            if own is None and method is not None:
                own = method if class_name is None else f"{class_name}.{method}"
            of_class = cls is not None and function is None and method is None
            of_any = own is not None or cls is not None
            if of_class:
                classes.append(cls)
            if of_any:
                inner.append(own or "")
            last[r.level] = of_class, of_any


#: Stands for a file as a whole, ahead of its statements.
FILE_ROW = Row(0, -1, 0, False, False, "", "")


def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of files (repo, file, seq, content, ...) with their scopes, each with the columns that name its file.

    If there are columns behind ``content``, each file also has a row of its own ahead of them, which holds these.
    """
    for batch in batches:
        keys, carried = batch.select(["repo", "file", "seq"]), batch.select(batch.schema.names[4:])
        rows, scopes, owner, first = [], [], [], []
        for k, text in enumerate(batch.column("content").to_pylist()):
            of_file = statements(text)
            if carried.num_columns:
                rows.append(FILE_ROW)
                scopes.append((None, None))
                first += [k] + [None] * len(of_file)
            rows += of_file
            scopes += around(of_file)
            owner += [k] * (len(rows) - len(owner))
            if len(rows) > 20000:
                yield _batch(keys, carried, owner, first, rows, scopes)
                rows, scopes, owner, first = [], [], [], []
        if rows:
            yield _batch(keys, carried, owner, first, rows, scopes)


def _batch(keys: pa.RecordBatch, carried: pa.RecordBatch, owner: list[int], first: list[int | None], rows: list[Row],
           scopes: list[tuple]) -> pa.RecordBatch:
    named = keys.take(pa.array(owner, pa.int32()))
    columns = [pa.array(values, kind) for values, (_, kind) in zip([*zip(*rows), *zip(*scopes)], FIELDS)]
    once = [c.take(pa.array(first, pa.int32())) for c in carried.columns]
    return pa.RecordBatch.from_arrays([*named.columns, *columns, *once],
                                      names=[*named.schema.names, *(name for name, _ in FIELDS), *carried.schema.names])
