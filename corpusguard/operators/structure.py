"""Code structure of JavaScript and TypeScript files as relations.

``line_facts`` lays a file out in rows of one statement each, in the stage that scans
it, and keeps extracted fields and the enclosing class and function only; ``scoped``
names the caller. Neither contents nor rows are shuffled for it, and the aggregates
below work by (repo, file, seq).

Where two readings of the same file differ, ``variant`` picks one: "summary"
feeds the roll-ups, "detail" feeds the call graph and the listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import lexical as L, scopes
from corpusguard.functions import text as T
from corpusguard.rules import FRAMEWORKS, JS, REPEAT_FACTOR, ROUTE_FRAMEWORK

FILE = ["repo", "file", "seq"]
VARIANTS = ("summary", "detail")
ROOT = "root"
BINDING = "array<struct<imported:string,local:string>>"


def code_files(files: DataFrame) -> DataFrame:
    """Files whose structure is read; others have none."""
    return files.where(F.col("file_type").isin(*JS))


def _import_struct(line: Column) -> Column:
    """Reads the staged columns _clause, _default, _namespace and _named."""
    default, namespace, named = F.col("_default"), F.col("_namespace"), F.col("_named")
    locals_ = F.transform(named, lambda p: F.coalesce(p["second"], p["first"]))

    def one(test, imported, local):
        return F.when(test.isNotNull(), F.array(F.struct(imported.alias("imported"), local.alias("local")))).otherwise(
            F.array().cast(BINDING))
    return F.struct(
        L.either(line, L.IMPORT_FROM, 2, 3).alias("source"),
        F.coalesce(namespace, default, F.get(locals_, F.lit(0))).alias("alias"),
        F.when(namespace.isNotNull(), "namespace").when(default.isNotNull(), "default")
        .when(F.size(named) > 0, "named").otherwise("side-effect").alias("type"),
        F.array_compact(F.concat(
            F.array(default, F.when(namespace.isNotNull(), F.lit("*"))),
            F.transform(named, lambda p: p["first"]))).alias("specifiers"),
        F.concat(
            one(default, F.lit("default"), default), one(namespace, F.lit("*"), namespace),
            F.transform(named, lambda p: F.struct(p["first"].alias("imported"),
                                                  F.coalesce(p["second"], p["first"]).alias("local"))),
        ).cast(BINDING).alias("bindings"))


def _stage_imports(lines: DataFrame) -> DataFrame:
    """Import clauses in parts; each step is computed once and read by the next."""
    line, clause = F.col("line"), F.col("_clause")
    return (lines.withColumn("_clause", F.when(line.contains("import") & line.rlike(L.IMPORT_FROM), L.import_clause(line)))
            .withColumn("_default", T.first_group(clause, L.CLAUSE_DEFAULT))
            .withColumn("_namespace", T.first_group(clause, L.CLAUSE_NAMESPACE))
            .withColumn("_named", F.when(clause.isNotNull(), L.named_pairs(F.regexp_extract(clause, L.CLAUSE_NAMED, 1)))))


def _side_effect_struct(line: Column) -> Column:
    return F.struct(
        L.either(line, L.IMPORT_ONLY, 1, 2).alias("source"), F.lit(None).cast("string").alias("alias"),
        F.lit("side-effect").alias("type"), F.array().cast("array<string>").alias("specifiers"),
        F.array().cast(BINDING).alias("bindings"))


def _require_struct(line: Column, head: Column) -> Column:
    target = F.regexp_extract(head, L.REQUIRE, 1)
    whole = ~target.startswith("{")
    # a property without a new name is bound under its own; one with a default is not bound
    keys = F.filter(L.items(F.regexp_replace(target, r"^\{|\}\z", "")), lambda p: p.rlike(L.REQUIRE_ITEM))
    pairs = F.transform(keys, lambda p: F.struct(
        F.regexp_extract(p, L.REQUIRE_ITEM, 1).alias("imported"),
        F.when(p.rlike(rf"^{L.I}\z"), p).otherwise(T.first_group(p, L.REQUIRE_ITEM, 2)).alias("local")))
    return F.struct(
        L.either(line, L.REQUIRED, 1, 2).alias("source"),
        F.when(whole, target).alias("alias"), F.lit("require").alias("type"),
        F.when(whole, F.array(target)).otherwise(F.transform(pairs, lambda p: p["imported"])).alias("specifiers"),
        F.when(whole, F.array(F.struct(F.lit("default").alias("imported"), target.alias("local"))))
        .otherwise(F.filter(pairs, lambda p: p["local"].isNotNull())).cast(BINDING).alias("bindings"))


def _export(name: Column, kind: str, alias: Column | None = None, variants=VARIANTS) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("type"),
                    (F.lit(None).cast("string") if alias is None else alias).alias("alias"),
                    F.array(*[F.lit(v) for v in variants]).alias("variants"))


def _export_items(line: Column, head: Column) -> Column:
    """What one statement exports; ``variants`` says which readings list it."""
    exported_fn = head.rlike(L.DECLARATION) & L.present(head, L.DECLARATION, 1)
    exported_class = head.rlike(L.CLASS) & L.present(head, L.CLASS, 1) & ~F.regexp_extract(head, L.CLASS, 3).isin(*L.NOT_A_NAME)
    fn_default, class_default = L.present(head, L.DECLARATION, 2), L.present(head, L.CLASS, 2)
    fn_name, class_name = F.regexp_extract(head, L.DECLARATION, 4), F.regexp_extract(head, L.CLASS, 3)
    default_name = T.first_group(line, L.EXPORT_DEFAULT_NAME)
    listed = F.transform(L.named_pairs(F.regexp_extract(line, L.EXPORT_LIST, 1)), lambda p: F.struct(
        F.coalesce(p["second"], p["first"]).alias("name"), F.lit("named").alias("type"),
        p["first"].alias("alias"), F.array(*[F.lit(v) for v in VARIANTS]).alias("variants")))
    return (F.when(exported_fn & fn_default, F.array(_export(fn_name, "default")))
            .when(exported_fn, F.array(_export(fn_name, "named")))
            .when(exported_class & class_default, F.array(_export(class_name, "default")))
            .when(exported_class, F.array(_export(class_name, "named")))
            .when(line.rlike(L.EXPORT_DEFAULT),
                  F.when(default_name.isNotNull() & ~default_name.isin(*L.NOT_A_NAME), F.array(_export(default_name, "default")))
                  .otherwise(F.array(_export(F.lit("default"), "default", variants=("summary",)))))
            .when(line.rlike(L.EXPORT_VARIABLE),
                  F.array(_export(F.regexp_extract(line, L.EXPORT_VARIABLE, 1), "named", variants=("detail",))))
            .when(line.rlike(L.EXPORT_LIST), listed)
            .when(line.rlike(L.EXPORT_NAMESPACE), F.array(_export(F.regexp_extract(line, L.EXPORT_NAMESPACE, 1), "named"))))


def _function_struct(line: Column) -> Column:
    def build(pattern, name, arguments, exported, exported_summary, is_async, kind, detail_kind, is_arrow):
        return F.when(line.rlike(pattern), F.struct(
            F.regexp_extract(line, pattern, name).alias("name"), L.params(arguments).alias("params"),
            exported_summary.alias("exported_summary"), exported.alias("exported_detail"),
            is_async.alias("is_async"), F.lit(is_arrow).alias("is_arrow"),
            F.lit(kind).alias("type_summary"), detail_kind.alias("type_detail")))
    declared = L.present(line, L.DECLARATION, 1)
    value_exported = L.present(line, L.FUNCTION_VALUE, 1)
    return F.coalesce(
        build(L.DECLARATION, 4, F.regexp_extract(line, L.DECLARATION, 5), declared,
              declared & ~L.present(line, L.DECLARATION, 2), L.present(line, L.DECLARATION, 3),
              "function", F.lit("function"), False),
        build(L.ARROW, 2, F.concat(F.regexp_extract(line, L.ARROW, 4), F.regexp_extract(line, L.ARROW, 6)),
              L.present(line, L.ARROW, 1), F.lit(False), L.present(line, L.ARROW, 3, 5), "arrow", F.lit("arrow"), True),
        build(L.FUNCTION_VALUE, 2, F.regexp_extract(line, L.FUNCTION_VALUE, 4), value_exported, F.lit(False),
              L.present(line, L.FUNCTION_VALUE, 3), "function",
              F.when(value_exported, F.lit("arrow")).otherwise(F.lit("function")), False))


def _class_struct(line: Column) -> Column:
    name = F.regexp_extract(line, L.CLASS, 3)
    exported = L.present(line, L.CLASS, 1)
    return F.when(line.rlike(L.CLASS) & ~name.isin(*L.NOT_A_NAME), F.struct(
        name.alias("name"), T.first_group(line, L.CLASS, 4).alias("extends"),
        (exported & ~L.present(line, L.CLASS, 2)).alias("exported_summary"), exported.alias("exported_detail")))


def _method_struct(line: Column) -> Column:
    return F.when(L.is_method_header(line), F.struct(
        F.regexp_extract(line, L.METHOD, 2).alias("name"), L.params(F.regexp_extract(line, L.METHOD, 3)).alias("params"),
        F.regexp_extract(line, L.METHOD, 1).contains("async").alias("is_async")))


def _route_struct(line: Column) -> Column:
    handler = F.coalesce(T.first_group(line, L.ROUTE_SECOND), T.first_group(line, L.ROUTE_ONLY))
    return F.when(line.rlike(L.ROUTE), F.struct(
        F.regexp_extract(line, L.ROUTE, 1).alias("method"),
        F.when(~handler.isin(*L.NOT_A_NAME), handler).alias("handler")))


ROW = "repo string, file string, seq bigint, line_no int, place int, level int, shut boolean, opens boolean, line string, head string, class_name string, inside string"


def _laid_out(files: DataFrame, *carried: str) -> DataFrame:
    head = F.col("head")
    if carried:
        read = files.select(*FILE, F.when(F.col("file_type").isin(*JS), F.col("content")).alias("content"), *carried)
    else:
        read = code_files(files).select(*FILE, "content")
    kept = [f"{c} {files.schema[c].dataType.simpleString()}" for c in carried]
    rows = read.mapInArrow(scopes.lay_out, ", ".join([ROW, *kept]))
    return rows.withColumn("_method", F.when(head.contains("(") & F.col("opens"), L.is_method_header(head)).otherwise(F.lit(False)))


def line_facts(files: DataFrame, *carried: str) -> DataFrame:
    """Structure-bearing statements of code files: one narrow pass, extracted fields only.

    With ``carried``, columns that are never null, every file also has one row without fields that holds these.

    The rows are not filtered on the extracted fields: Spark would push such a filter
    below the projection and extract everything twice.
    """
    line, head = F.col("line"), F.col("head")
    staged = _stage_imports(_laid_out(files, *carried))
    return staged.select(
        *FILE, "line_no", "place", "level", "shut", "opens", "class_name", "inside", *carried,
        F.when(F.col("_clause").isNotNull(), _import_struct(line))
        .when(line.contains("import") & line.rlike(L.IMPORT_ONLY), _side_effect_struct(line)).alias("imported"),
        F.when(head.contains("require") & head.rlike(L.REQUIRE), _require_struct(line, head)).alias("required"),
        F.when(line.contains("export"), _export_items(line, head)).alias("exports"),
        F.when(head.contains("function") | head.contains("=>"), _function_struct(head)).alias("fn"),
        F.when(head.contains("class"), _class_struct(head)).alias("cls"),
        F.when(F.col("_method"), _method_struct(head)).alias("method"),
        F.when(line.contains("("), L.called_names(line, F.col("_method"))).alias("calls"),
        F.when(line.contains("fetch"), L.file_endpoint(line)).alias("file_call"),
        F.when(line.contains("router.") | line.contains("app."), _route_struct(line)).alias("route"))


def signal_facts(files: DataFrame) -> DataFrame:
    """What roles, dependencies and frameworks read of ``line_facts``, with the same rows and names.

    Parameters, bindings and calls, which cost most, are left out: Spark does not drop unread
    fields of a struct that is built under a condition.
    """
    line, head = F.col("line"), F.col("head")
    source = F.when(line.contains("import"), F.when(line.rlike(L.IMPORT_FROM), L.either(line, L.IMPORT_FROM, 2, 3))
                    .when(line.rlike(L.IMPORT_ONLY), L.either(line, L.IMPORT_ONLY, 1, 2)))
    function, value = head.contains("function"), head.contains("=>")
    named = F.coalesce(F.when(function & head.rlike(L.DECLARATION), F.regexp_extract(head, L.DECLARATION, 4)),
                       F.when(value & head.rlike(L.ARROW), F.regexp_extract(head, L.ARROW, 2)),
                       F.when(function & head.rlike(L.FUNCTION_VALUE), F.regexp_extract(head, L.FUNCTION_VALUE, 2)))
    cls = F.regexp_extract(head, L.CLASS, 3)
    staged = _laid_out(files).withColumn("_source", source).withColumn("_fn", named)
    return staged.select(
        *FILE, "line_no", "place", "class_name",
        F.when(F.col("_source").isNotNull(), F.struct(F.col("_source").alias("source"), F.lit("import").alias("type"))).alias("imported"),
        F.when(head.contains("require") & head.rlike(L.REQUIRE), F.struct(
            L.either(line, L.REQUIRED, 1, 2).alias("source"), F.lit("require").alias("type"))).alias("required"),
        F.when(line.contains("export"), _export_items(line, head)).alias("exports"),
        F.when(F.col("_fn").isNotNull(), F.struct(F.col("_fn").alias("name"))).alias("fn"),
        F.when(head.contains("class") & head.rlike(L.CLASS) & ~cls.isin(*L.NOT_A_NAME), F.struct(cls.alias("name"))).alias("cls"),
        F.when(F.col("_method"), F.struct(F.regexp_extract(head, L.METHOD, 2).alias("name"))).alias("method"),
        F.when(line.contains("router.") | line.contains("app."), _route_struct(line)).alias("route"))


def scoped(facts: DataFrame) -> DataFrame:
    """Add ``caller``: the function that a row heads, else the innermost one whose body it is in."""
    own = F.coalesce(F.col("fn.name"), F.when(F.col("method").isNotNull(), method_name()))
    carried = F.when(F.col("inside") != "", F.col("inside"))
    return facts.withColumn("caller", F.coalesce(own, carried, F.lit(ROOT))).drop("inside")


def method_name() -> Column:
    return F.concat_ws(".", F.col("class_name"), F.col("method.name"))


def events(files: DataFrame, *carried: str) -> DataFrame:
    return scoped(line_facts(files, *carried))


# --- relations ------------------------------------------------------------

def imports(facts: DataFrame) -> DataFrame:
    """ES imports."""
    return _import_rows(facts, "imported")


def requires(facts: DataFrame) -> DataFrame:
    return _import_rows(facts, "required")


def _import_rows(facts: DataFrame, column: str) -> DataFrame:
    return facts.where(F.col(column).isNotNull()).select(*FILE, "line_no", "place", f"{column}.*")


def all_imports(facts: DataFrame) -> DataFrame:
    return (facts.withColumn("_imp", F.coalesce("imported", "required")).where(F.col("_imp").isNotNull())
            .select(*FILE, "line_no", "place", "_imp.*"))


def bindings(imports_df: DataFrame) -> DataFrame:
    return (imports_df.select(*FILE, "line_no", "place", "source", F.posexplode("bindings").alias("pos", "_b"))
            .select(*FILE, "line_no", "place", "source", "pos", "_b.imported", "_b.local"))


def exports(facts: DataFrame, variant: str = "summary") -> DataFrame:
    rows = (facts.where(F.col("exports").isNotNull())
            .select(*FILE, "line_no", "place", F.posexplode("exports").alias("pos", "_e"))
            .where(F.array_contains("_e.variants", variant))
            .select(*FILE, "line_no", "place", "pos", "_e.name", "_e.type", "_e.alias"))
    if variant == "summary":
        return rows
    first = rows.groupBy(*FILE, "line_no", "name").agg(F.min_by(F.struct("place", "pos", "type", "alias"), F.struct("place", "pos")).alias("_e"))
    return first.select(*FILE, "line_no", "_e.place", "_e.pos", "name", "_e.type", "_e.alias")


def default_exports(facts: DataFrame, variant: str = "summary") -> DataFrame:
    return exports(facts, variant).where(F.col("type") == "default")


def function_rows(events_df: DataFrame, variant: str = "summary") -> DataFrame:
    """Every function and method header, before same-name merging; one pass over the lines."""
    is_fn = F.col("fn").isNotNull()

    def pick(of_function: Column, of_method: Column) -> Column:
        return F.when(is_fn, of_function).otherwise(of_method)
    return events_df.where(is_fn | lists_method(variant)).select(
        *FILE, "line_no", "place", pick(F.col("fn.name"), method_name()).alias("name"),
        pick(F.col("fn.params"), F.col("method.params")).alias("params"),
        pick(F.col(f"fn.exported_{variant}"), F.lit(False)).alias("exported"),
        pick(F.col("fn.is_async"), F.col("method.is_async")).alias("is_async"),
        pick(F.col("fn.is_arrow"), F.lit(False)).alias("is_arrow"),
        pick(F.col(f"fn.type_{variant}"), F.lit("method")).alias("type"))


def lists_method(variant: str) -> Column:
    """Object methods count in the detail variant only."""
    in_scope = F.col("class_name").isNotNull() if variant == "summary" else F.lit(True)
    return F.col("method").isNotNull() & F.col("fn").isNull() & in_scope


def method_rows(events_df: DataFrame, variant: str = "summary") -> DataFrame:
    return function_rows(events_df.where(lists_method(variant)), variant)


def _ordered(value: Column, order: Column) -> Column:
    """Collected values of a file-sized group, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def merge_functions(rows: DataFrame, variant: str = "summary") -> DataFrame:
    """Same-name functions of a file become one; the first line wins."""
    first = F.min_by(F.struct("params", "is_async", "is_arrow", "type"), "place")
    merged = rows.groupBy(*FILE, "name").agg(
        F.min("line_no").alias("line_no"), F.min("place").alias("place"), first.alias("_f"), F.bool_or("exported").alias("exported"),
        F.bool_or("is_async").alias("_any_async"),
        F.array_distinct(F.flatten(_ordered(F.col("params"), F.col("place")))).alias("_all_params"))
    union = variant == "detail"
    return merged.select(
        *FILE, "name", "line_no", "place", (F.col("_all_params") if union else F.col("_f.params")).alias("params"), "exported",
        (F.col("_any_async") if union else F.col("_f.is_async")).alias("is_async"), "_f.is_arrow", "_f.type")


def functions(events_df: DataFrame, variant: str = "summary") -> DataFrame:
    return merge_functions(function_rows(events_df, variant), variant)


def classes(events_df: DataFrame, variant: str = "summary") -> DataFrame:
    """Classes with their distinct method names in order; same-name classes merge."""
    is_class = F.col("cls").isNotNull()
    is_method = lists_method("summary")
    members = events_df.where(is_class | is_method).select(
        *FILE, "line_no", "place", F.coalesce("cls.name", "class_name").alias("name"), F.col("cls.extends").alias("extends"),
        F.coalesce(f"cls.exported_{variant}", F.lit(False)).alias("exported"),
        F.when(is_class, F.struct("place", "line_no")).alias("_header"), F.when(~is_class, F.col("method.name")).alias("method"))
    return members.groupBy(*FILE, "name").agg(
        F.min("_header.line_no").alias("line_no"), F.min("_header.place").alias("place"), F.min_by("extends", "_header").alias("extends"),
        F.bool_or("exported").alias("exported"),
        F.array_distinct(F.array_compact(_ordered(F.col("method"), F.col("place")))).alias("methods"))


def call_rows(events_df: DataFrame, variant: str = "summary") -> DataFrame:
    calls = events_df.where(F.size("calls") > 0)
    return (calls.select(*FILE, "line_no", "place", "caller", F.posexplode(listed_calls(variant)).alias("pos", "callee"))
            .where(F.col("caller") != F.col("callee")))


def listed_calls(variant: str = "summary") -> Column:
    """The calls of one line; the detail variant lists a request to a file apart."""
    if variant == "summary":
        return F.col("calls")
    return F.when(F.col("file_call").isNotNull(), F.filter("calls", lambda c: c != "fetch")).otherwise(F.col("calls"))


def call_edges(events_df: DataFrame, variant: str = "summary") -> DataFrame:
    """Distinct (caller, callee), with the place they were first seen."""
    return (call_rows(events_df, variant).groupBy(*FILE, "caller", "callee")
            .agg(F.min(F.struct("line_no", "place", "pos")).alias("ord")).withColumn("type", F.lit("call")))


def file_calls(events_df: DataFrame) -> DataFrame:
    """Distinct (caller, path) of fetches whose literal path ends like a source file."""
    return (events_df.where(F.col("file_call").isNotNull())
            .groupBy(*FILE, "caller", F.col("file_call").alias("path"))
            .agg(F.min("line_no").alias("line_no"), F.min("place").alias("place")).withColumn("type", F.lit("http")))


def routes(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("route").isNotNull()).select(*FILE, "line_no", "route.*")


def entry_names(variant: str = "summary") -> Column:
    """Entry points of one line: its default export and its route handler."""
    default = F.filter("exports", lambda e: (e["type"] == "default") & F.array_contains(e["variants"], variant))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.transform(default, lambda e: e["name"]), none),
                    F.array_compact(F.array(F.col("route.handler"))))


def entry_points(facts: DataFrame, variant: str = "summary") -> DataFrame:
    """Distinct entry points with the line first seen."""
    return (facts.where(F.col("exports").isNotNull() | F.col("route").isNotNull())
            .select(*FILE, "line_no", "place", F.explode(entry_names(variant)).alias("name"))
            .groupBy(*FILE, "name").agg(F.min("line_no").alias("line_no"), F.min("place").alias("place")))


def backfill_calls(functions_df: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with the distinct callees of their edges, in order."""
    callees = edges.groupBy(*FILE, F.col("caller").alias("name")).agg(_ordered(F.col("callee"), F.col("ord")).alias("calls"))
    return (functions_df.join(callees, [*FILE, "name"], "left")
            .withColumn("calls", F.coalesce("calls", F.array().cast("array<string>"))))


def dependency_name(source: Column) -> Column:
    no_suffix = F.regexp_replace(source, r"(?i)\.(?:tsx?|jsx?)\z", "")
    return F.regexp_replace(F.regexp_replace(no_suffix, r"^\./", ""), r"^/", "")


def dependencies(facts: DataFrame) -> DataFrame:
    """Distinct names of relative and absolute imports."""
    local = all_imports(facts).where(F.col("source").startswith(".") | F.col("source").startswith("/"))
    return (local.groupBy(*FILE, dependency_name(F.col("source")).alias("dependency"))
            .agg(F.min("line_no").alias("line_no"), F.min("place").alias("place")))


def signal_array(variant: str = "summary") -> Column:
    """Framework signals of one line, in order: its import by name, or its router call."""
    imp = F.coalesce("imported", "required")
    source, required = imp["source"], imp["type"] == "require"
    kind = F.when(required, F.lit("require")).otherwise(F.lit("import"))

    def signal(test, position, framework, weight, reason):
        return F.when(test, F.struct(F.lit(position).alias("pos"), F.lit(framework).alias("framework"),
                                     F.lit(weight).alias("weight"), reason.alias("reason")))
    slots = []
    for position, (word, framework, weight) in enumerate(FRAMEWORKS):
        counts = source.contains(word)
        if variant == "detail" and word != "express":
            counts = counts & ~required
        slots.append(signal(counts, position, framework, weight, F.concat(F.lit(word + " "), kind)))
    framework, weight = ROUTE_FRAMEWORK
    slots.append(signal(F.col("route").isNotNull(), len(FRAMEWORKS), framework, weight,
                        F.concat(F.lit("router."), F.col("route.method"), F.lit(" usage"))))
    return F.array_compact(F.array(*slots))


def framework_signals(facts: DataFrame, variant: str = "summary") -> DataFrame:
    """One row per signal."""
    return (facts.select(*FILE, "line_no", "place", F.explode(signal_array(variant)).alias("_s"))
            .select(*FILE, "line_no", "place", "_s.*"))


def framework_signals_by_variant(facts: DataFrame) -> DataFrame:
    """``framework_signals`` of both variants, named by ``variant``, from one scan of the facts."""
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), signal_array(v).alias("_l")) for v in VARIANTS]))
    rows = facts.select(*FILE, "line_no", "place", both.alias("_v"))
    return (rows.select(*FILE, "line_no", "place", "_v.variant", F.explode("_v._l").alias("_s"))
            .select(*FILE, "line_no", "place", "variant", "_s.*"))


def framework_hints(signals: DataFrame, variant: str = "summary") -> DataFrame:
    """Confidence per framework: the first signal counts in full, repeats in part, at most 1."""
    order = F.struct("place", "pos")
    reasons = _ordered(F.col("reason"), order)
    first = F.min_by("weight", order)
    return signals.groupBy(*FILE, "framework").agg(
        F.min(order).alias("ord"),
        F.least(F.lit(1.0), first + F.lit(REPEAT_FACTOR) * (F.sum("weight") - first)).alias("confidence"),
        (F.array_distinct(reasons) if variant == "summary" else reasons).alias("reason"))
