"""One row per file: structure, role, metrics and finding titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.operators import roles, structure as S
from corpusguard.rules import REPEAT_FACTOR

FILE = S.FILE
PARTS = ("imports", "exports", "functions", "classes", "call_graph", "framework_hints", "entry_points", "dependencies")
#: What ``payload.listing`` displays.
LISTED = ("imports", "exports", "functions", "classes", "framework_hints")
FUNCTION = ("struct<name:string,line:int,params:array<string>,exported:boolean,is_async:boolean,is_arrow:boolean,"
            "type:string>")


def titles_per_file(findings: DataFrame) -> DataFrame:
    """Distinct finding titles of a file in first-seen order; the rule set bounds their number."""
    seen = findings.groupBy("repo", "file", "title").agg(F.min(F.struct("line", "rule_ord")).alias("o"))
    pairs = F.array_sort(F.collect_list(F.struct("o", "title")))
    return seen.groupBy("repo", "file").agg(F.transform(pairs, lambda p: p["title"]).alias("finding_titles"))


def _named(**fields: Column) -> Column:
    """A struct whose names also hold inside the functions of lists, where aliases are lost."""
    return F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)])


def _said(variant: str, parts: tuple[str, ...]) -> Column:
    """What one structure row says for ``parts``, null if nothing."""
    place, line, detail = F.col("place"), F.col("line_no"), variant == "detail"
    fields, tests = {}, []

    def say(name: str, value: Column, test: Column) -> None:
        fields[name] = value
        tests.append(test)
    if "imports" in parts or "dependencies" in parts:
        i = F.coalesce("imported", "required")
        say("imported", F.when(i.isNotNull(), _named(source=i["source"], alias=i["alias"], type=i["type"], line=line,
                                                    specifiers=i["specifiers"], bindings=i["bindings"])), i.isNotNull())
    if "exports" in parts:
        listed = F.filter("exports", lambda e: F.array_contains(e["variants"], variant))
        say("exports", F.transform(listed, lambda e, k: _named(
            line=line, name=e["name"], place=place, pos=k, type=e["type"], alias=e["alias"])), F.size("exports") > 0)
        names = F.transform(listed, lambda e: e["name"])
        fields["export_count"] = F.size(F.array_distinct(names) if detail else names)
    if "functions" in parts:
        is_fn = F.col("fn").isNotNull()

        def pick(of_function: Column, of_method: Column) -> Column:
            return F.when(is_fn, of_function).otherwise(of_method)
        test = is_fn | S.lists_method(variant)
        say("fn", F.when(test, _named(
            name=pick(F.col("fn.name"), S.method_name()), line=line, params=pick(F.col("fn.params"), F.col("method.params")),
            exported=pick(F.col(f"fn.exported_{variant}"), F.lit(False)), is_async=pick(F.col("fn.is_async"), F.col("method.is_async")),
            is_arrow=pick(F.col("fn.is_arrow"), F.lit(False)), type=pick(F.col(f"fn.type_{variant}"), F.lit("method")))), test)
    if "classes" in parts:
        is_class = F.col("cls").isNotNull()
        test = is_class | S.lists_method("summary")
        say("member", F.when(test, _named(
            name=F.coalesce("cls.name", "class_name"), place=place, header=is_class, line=line, extends=F.col("cls.extends"),
            exported=F.coalesce(f"cls.exported_{variant}", F.lit(False)), method=F.when(~is_class, F.col("method.name")))), test)
    if "call_graph" in parts:
        say("calls", F.transform(F.filter(S.listed_calls(variant), lambda c: c != F.col("caller")), lambda c, k: _named(
            name=F.col("caller"), is_call=F.lit(True), callee=c, line=line, place=place, pos=k, fn=F.lit(None).cast(FUNCTION))),
            F.size("calls") > 0)
    if "framework_hints" in parts:
        say("hints", S.signal_array(variant), F.coalesce("imported.source", "required.source", "route.method").isNotNull())
    if "entry_points" in parts:
        say("entries", F.array_sort(S.entry_names(variant)), F.col("exports").isNotNull() | F.col("route").isNotNull())
    if "file_calls" in parts:
        say("file_call", F.when(F.col("file_call").isNotNull(), _named(
            caller=F.col("caller"), path=F.col("file_call"), place=place, type=F.lit("http"))), F.col("file_call").isNotNull())
    return F.when(reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests]), _named(place=place, **fields))


def _first_of(rows: str, *keys: str) -> Column:
    """Of rows sorted by ``keys``, the first of each value."""
    def differs(r: Column, i: Column) -> Column:
        before = F.get(F.col(rows), i - 1)
        return (i == 0) | reduce(Column.__or__, [~before[k].eqNullSafe(r[k]) for k in keys])
    return F.filter(rows, differs)


def _with_groups(df: DataFrame, rows: str) -> DataFrame:
    """Turn rows sorted by name into an array of those of each name. Each step is a column, so that none is told per element."""
    one = F.sequence(F.lit(1), F.size(rows))
    starts = F.filter(F.when(F.size(rows) > 0, one).otherwise(F.array().cast("array<int>")), lambda k: (k == 1) | ~F.get(
        F.col(rows), k - 2)["name"].eqNullSafe(F.get(F.col(rows), k - 1)["name"]))
    end = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1), F.size(rows) + 1)
    return df.withColumn("_starts", starts).withColumn(
        rows, F.transform("_starts", lambda s, k: F.slice(rows, s, end(k) - s))).drop("_starts")


def _in_order(rows: Column, place: list[str], shape) -> Column:
    """Rows as ``shape`` makes them, by the fields of ``place``."""
    items = F.transform(rows, lambda r: _named(at=_named(**{p: r[p] for p in place}), of=shape(r)))
    return F.transform(F.array_sort(items), lambda i: i["of"])


def _function(group: Column, union: bool) -> Column:
    """The function of a name and its calls; of several the first counts."""
    own, first = F.filter(group, lambda r: ~r["is_call"]), F.get(group, F.lit(0))
    fn = first["fn"]
    params = F.array_distinct(F.flatten(F.transform(own, lambda r: r["fn"]["params"]))) if union else fn["params"]
    return _named(
        place=first["place"], name=fn["name"], line=F.array_min(F.transform(own, lambda r: r["fn"]["line"])), params=params,
        exported=F.exists(own, lambda r: r["fn"]["exported"]),
        calls=_in_order(F.filter(group, lambda r: r["is_call"]), ["line", "place", "pos"], lambda r: r["callee"]),
        is_async=F.exists(own, lambda r: r["fn"]["is_async"]) if union else fn["is_async"], is_arrow=fn["is_arrow"], type=fn["type"])


def _class(group: Column) -> Column:
    """The class of a name with its distinct methods in order."""
    first = F.get(F.filter(group, lambda r: r["header"]), F.lit(0))
    return _named(
        place=first["place"], name=F.get(group, F.lit(0))["name"], line=first["line"], extends=first["extends"],
        exported=F.exists(group, lambda r: r["exported"]),
        methods=F.array_distinct(F.array_compact(F.transform(group, lambda r: r["method"]))))


def _picked(*names: str):
    return lambda r: _named(**{n: r[n] for n in names})


def _hint(framework: Column, signals: Column, variant: str) -> Column:
    own = F.filter(signals, lambda s: s["framework"] == framework)
    first, reasons = F.get(own, F.lit(0))["weight"], F.transform(own, lambda s: s["reason"])
    total = F.aggregate(own, F.lit(0.0), lambda t, s: t + s["weight"])
    return _named(framework=framework, confidence=F.least(F.lit(1.0), first + F.lit(REPEAT_FACTOR) * (total - first)),
                  reason=F.array_distinct(reasons) if variant == "summary" else reasons)


def nested(events: DataFrame, variant: str = "summary", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per file of ``events`` with a list for each of ``parts``, and the signals that the file's own row holds.

    One aggregate and one shuffle, of a file's rows by its key; a file bounds its lists. Within a file, names are
    merged by sorting and looking at neighbours, so that no step is quadratic.
    """
    if variant == "detail" and "entry_points" in parts:
        parts = (*parts, "file_calls")
    carried = "signals" in events.columns
    rows = F.col("_rows")

    def each(field: str) -> Column:
        return F.transform(F.filter(rows, lambda r: r[field].isNotNull()), lambda r: r[field])
    out = events.groupBy(*FILE).agg(
        F.array_sort(F.collect_list(_said(variant, parts))).alias("_rows"),
        *([F.collect_list("signals").alias("_signals")] if carried else []))
    lists = {p: F.col(p) for p in parts}
    first: dict[str, Column] = {}
    if "imports" in parts:
        first["imports"] = each("imported")
    if "dependencies" in parts:
        local = F.filter(each("imported"), lambda i: i["source"].startswith(".") | i["source"].startswith("/"))
        first["dependencies"] = F.array_distinct(F.transform(local, lambda i: S.dependency_name(i["source"])))
    if "exports" in parts:
        first["_exports"] = F.flatten(each("exports"))
        if variant == "detail":
            first["_exports"] = F.array_sort(first["_exports"])
        first["export_count"] = F.aggregate(rows, F.lit(0), lambda n, r: n + F.greatest(r["export_count"], F.lit(0)))
    if "functions" in parts:
        own = F.transform(F.filter(rows, lambda r: r["fn"].isNotNull()), lambda r: _named(
            name=r["fn"]["name"], is_call=F.lit(False), callee=F.lit(""), line=F.lit(0), place=r["place"], pos=F.lit(0), fn=r["fn"]))
        first["_symbols"] = F.array_sort(F.concat(own, F.flatten(each("calls"))) if "call_graph" in parts else own)
    if "classes" in parts:
        first["_members"] = F.array_sort(each("member"))
    if "framework_hints" in parts:
        first["_hints"] = F.flatten(each("hints"))
    if "entry_points" in parts:
        first["entry_points"] = F.array_distinct(F.flatten(each("entries")))
    if "file_calls" in parts:
        first["_requests"] = F.array_sort(each("file_call"))
    out = out.select(*FILE, *(["_signals"] if carried else []), *[c.alias(n) for n, c in first.items()])
    if "exports" in parts:
        kept = _first_of("_exports", "line", "name") if variant == "detail" else F.col("_exports")
        lists["exports"] = _in_order(kept, ["place", "pos"], _picked("name", "line", "type", "alias"))
    if "functions" in parts:
        # calls of a function once, the first of each name called
        out = out.withColumn("_symbols", F.filter("_symbols", lambda r, i: ~r["is_call"] | (i == 0) | ~F.get(F.col("_symbols"), i - 1)[
            "callee"].eqNullSafe(r["callee"]) | ~F.get(F.col("_symbols"), i - 1)["name"].eqNullSafe(r["name"])))
        if "call_graph" in parts:
            out = out.withColumn("_calls", F.filter("_symbols", lambda r: r["is_call"]))
            lists["call_graph"] = _in_order(F.col("_calls"), ["line", "place", "pos"], lambda r: _named(
                caller=r["name"], callee=r["callee"], type=F.lit("call")))
        out = _with_groups(out, "_symbols")
        functions = F.transform(F.filter("_symbols", lambda g: ~F.get(g, F.lit(0))["is_call"]), lambda g: _function(g, variant == "detail"))
        lists["functions"] = _in_order(functions, ["place"], _picked(
            "name", "line", "params", "exported", "calls", "is_async", "is_arrow", "type"))
    if "classes" in parts:
        out = _with_groups(out, "_members")
        lists["classes"] = _in_order(F.transform("_members", _class), ["place"], _picked("name", "line", "extends", "exported", "methods"))
    if "framework_hints" in parts:
        named = F.array_distinct(F.transform("_hints", lambda s: s["framework"]))
        lists["framework_hints"] = F.transform(named, lambda f: _hint(f, F.col("_hints"), variant))
    if "file_calls" in parts:
        lists["file_calls"] = _in_order(_first_of("_requests", "caller", "path"), ["place"], _picked("caller", "path", "type"))
    shown = [c.alias(n) for n, c in lists.items()]
    if "exports" in parts:
        shown.append(F.col("export_count"))
    if not carried:
        return out.select(*FILE, *shown)
    # as many rows as the file has in the corpus
    return out.select(*FILE, *shown, F.explode("_signals").alias("_signals")).select("*", "_signals.*").drop("_signals")


def build_listed(files: DataFrame, variant: str = "detail") -> DataFrame:
    """What ``payload.listing`` reads of ``build_metadata``, without roles, calls and findings."""
    return nested(S.events(files.withColumn("signals", F.struct("file_type")), "signals"), variant, LISTED)


def build_metadata(files: DataFrame, findings: DataFrame, events: DataFrame | None = None,
                   variant: str = "summary", profiles: DataFrame | None = None) -> DataFrame:
    """``files`` are analyzable files. Everything is gathered by file key; contents are never shuffled.

    Without ``events`` the contents are scanned once for all but the findings. ``profiles`` of the
    same files and variant spare another scan of the contents.
    """
    if events is None and profiles is None:
        lists = nested(S.events(roles.with_text_signals(files), "signals"), variant)
        out = roles.with_role(lists.withColumns(roles.nested_signals()), variant).withColumnRenamed("loc", "lines_of_code")
    else:
        events = S.events(files) if events is None else events
        out = roles.profiles(files, events, variant) if profiles is None else profiles
        lists = nested(events, variant).drop("export_count")
        out = out.join(lists, FILE, "left").withColumns(
            {n: F.coalesce(n, F.array().cast(lists.schema[n].dataType)) for n in lists.columns if n not in FILE})
    out = (out.join(titles_per_file(findings), ["repo", "file"], "left")
           .withColumn("finding_titles", F.coalesce("finding_titles", F.array().cast("array<string>")))
           .withColumn("metrics", F.struct("lines_of_code", "function_count", "class_count", "import_count", "export_count")))
    columns = [*FILE, "file_type", "imports", "exports", "functions", "classes", "call_graph", "framework_hints",
               "finding_titles", "module_purpose", "responsibilities", "confidence", "metrics", "entry_points",
               "dependencies"]
    if variant == "detail":
        out = out.withColumn("ast_status", roles.status(F.col("file_type")))
        columns += ["ast_status", "file_calls"]
    return out.select(*columns)
