"""File roles: word and path signals, structure counts, purpose, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.operators import prepare, structure as S
from corpusguard.rules import API, AUTH, DATA, GENERAL, RESPONSIBILITIES, SERVICE, STATUS_EXTENSIONS, UI

FILE = S.FILE
ENTRY_HINT = r"(?i)login|auth|signup"


def _text_flags() -> list[Column]:
    lower = F.col("_lower")
    return [
        T.has_word(lower, "jwt", "token").alias("auth_word"), T.has_word(lower, "router").alias("router_word"),
        T.has_word(lower, "service").alias("service_word"), T.has_word(lower, "schema", "model").alias("data_word"),
        T.has_word(F.col("content"), "useState", "useEffect").alias("hook_word")]


def _read_texts(files: DataFrame) -> DataFrame:
    return prepare.with_loc(files).withColumn("_lower", F.lower("content"))


def text_signals(files: DataFrame) -> DataFrame:
    """What the role needs from the text, reduced to flags before anything is shuffled."""
    return _read_texts(files).select(*FILE, "file_type", "loc", *_text_flags())


def with_text_signals(files: DataFrame) -> DataFrame:
    """The files with the columns of ``text_signals`` as one, ``signals``."""
    return _read_texts(files).select(*FILE, "file_type", "content", F.struct("file_type", "loc", *_text_flags()).alias("signals"))


def _counts(events: DataFrame, variant: str) -> list[Column]:
    source = F.coalesce(F.col("imported.source"), F.col("required.source"))
    listed = F.filter(F.coalesce("exports", F.array().cast(events.schema["exports"].dataType)),
                      lambda e: F.array_contains(e["variants"], variant))
    export_names = F.transform(listed, lambda e: e["name"])
    if variant == "detail":
        export_names = F.array_distinct(export_names)
    entries = S.entry_names(variant)
    in_class = F.col("class_name").isNotNull() if variant == "summary" else F.lit(True)
    function_name = F.coalesce("fn.name", F.when(F.col("method").isNotNull() & in_class, S.method_name()))
    frameworks = F.transform(S.signal_array(variant), lambda s: s["framework"])
    return [
        F.count(source).cast("int").alias("import_count"),
        F.sum(F.size(export_names)).cast("int").alias("export_count"),
        F.size(F.collect_set(function_name)).alias("function_count"),
        F.size(F.collect_set("cls.name")).alias("class_count"),
        F.array_distinct(F.flatten(F.collect_list(frameworks))).alias("frameworks"),
        F.coalesce(F.bool_or(source.contains("jsonwebtoken")), F.lit(False)).alias("imports_jwt"),
        F.coalesce(F.bool_or(source.contains("bcrypt")), F.lit(False)).alias("imports_bcrypt"),
        F.coalesce(F.bool_or(source.contains("express")), F.lit(False)).alias("imports_express"),
        F.bool_or(F.exists(entries, lambda e: e.rlike(ENTRY_HINT))).alias("auth_entry"),
        F.bool_or(F.size(entries) > 0).alias("has_entry")]


def nested_signals() -> dict[str, Column]:
    """The columns of ``structure_signals`` from the lists of a file's metadata."""
    def imported(name: str) -> Column:
        return F.coalesce(F.exists("imports", lambda i: i["source"].contains(name)), F.lit(False))
    return {
        "import_count": F.size(F.filter("imports", lambda i: i["source"].isNotNull())),
        "export_count": F.col("export_count").cast("int"),
        "function_count": F.size("functions"),
        "class_count": F.size(F.filter("classes", lambda c: c["line"].isNotNull())),
        "frameworks": F.transform("framework_hints", lambda h: h["framework"]),
        "imports_jwt": imported("jsonwebtoken"), "imports_bcrypt": imported("bcrypt"), "imports_express": imported("express"),
        "auth_entry": F.exists("entry_points", lambda e: e.rlike(ENTRY_HINT)), "has_entry": F.size("entry_points") > 0}


def structure_signals(events: DataFrame, variant: str = "summary") -> DataFrame:
    """Counts and flags per file from one aggregate over its structure lines."""
    return events.groupBy(*FILE).agg(*_counts(events, variant))


def purpose(variant: str = "summary") -> Column:
    """The ordered role ladder over the columns of ``signals``."""
    path = F.lower(F.col("file"))

    def named(*words):
        test = F.lit(False)
        for w in words:
            test = test | path.contains(w)
        return test
    frameworks = F.col("frameworks")
    ladder = (F.when(named("auth", "login", "session") | F.col("imports_jwt") | F.col("imports_bcrypt") | F.col("auth_word"), AUTH)
              .when(named("controller", "route") | (F.array_contains(frameworks, "Express") & F.col("router_word")), API)
              .when(named("service") | F.col("service_word"), SERVICE)
              .when(named("repository", "repo") | F.col("data_word"), DATA)
              .when(F.array_contains(frameworks, "React") | path.endswith(".tsx") | path.endswith(".jsx") | F.col("hook_word"), UI)
              .when(F.col("auth_entry"), AUTH))
    if variant == "detail":
        ladder = ladder.when(F.col("has_entry") & path.contains("page"), UI)
    return ladder.otherwise(GENERAL)


def responsibilities(variant: str = "summary") -> Column:
    """Fixed tags per purpose plus what the imports suggest."""
    fixed = F.create_map(*[x for k, v in RESPONSIBILITIES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    tags = [F.element_at(fixed, F.col("module_purpose"))]
    if variant == "detail":
        is_auth = F.col("module_purpose") == AUTH
        tags.append(F.array_compact(F.array(
            F.when(is_auth & F.col("imports_bcrypt"), F.lit("Password Verification")),
            F.when(is_auth & F.col("imports_jwt"), F.lit("Token Generation")),
            F.when(is_auth & F.col("imports_jwt"), F.lit("Token Validation")))))
    tags.append(F.array_compact(F.array(
        F.when(F.col("imports_express"), F.lit("Routing")),
        F.when(F.array_contains("frameworks", "Next.js"), F.lit("Page Rendering")))))
    return F.array_distinct(F.concat(*tags))


def confidence() -> Column:
    signals = F.col("import_count") * 8 + F.col("function_count") * 4 + F.size("frameworks") * 6
    return F.least(F.lit(100), 40 + F.least(F.lit(50), signals)).cast("int")


def status(file_type: Column) -> Column:
    """parse-failed never arises here: nothing is parsed."""
    return F.when(file_type.isin(*STATUS_EXTENSIONS), F.lit("analyzed")).otherwise(F.lit("unsupported"))


def _filled(joined: DataFrame) -> DataFrame:
    """Files without structure lines count nothing."""
    zero = {c: 0 for c in ("import_count", "export_count", "function_count", "class_count")}
    false = {c: False for c in ("imports_jwt", "imports_bcrypt", "imports_express", "auth_entry", "has_entry")}
    return (joined.fillna(zero).fillna(false)
            .withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>"))))


def signals(files: DataFrame, events: DataFrame, variant: str = "summary") -> DataFrame:
    return _filled(text_signals(files).join(structure_signals(events, variant), FILE, "left"))


PROFILE = [*FILE, "file_type", "module_purpose", "responsibilities", "confidence", "loc AS lines_of_code",
           "function_count", "class_count", "import_count", "export_count", "frameworks"]


def profiles(files: DataFrame, events: DataFrame, variant: str = "summary") -> DataFrame:
    """One row per file without nested detail: role, tags, confidence, counts. ``events`` or ``signal_facts`` will do."""
    return with_role(signals(files, events, variant), variant).selectExpr(*PROFILE)


def with_role(signals_df: DataFrame, variant: str = "summary") -> DataFrame:
    return (signals_df.withColumn("module_purpose", purpose(variant))
            .withColumn("responsibilities", responsibilities(variant))
            .withColumn("confidence", confidence()))


def profiles_by_variant(files: DataFrame, events: DataFrame) -> DataFrame:
    """``profiles`` of both variants, named by ``variant``, from one scan of the texts and one of the structure lines."""
    counted = events.groupBy(*FILE).agg(*[F.struct(*_counts(events, v)).alias(v) for v in S.VARIANTS])
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("_s")) for v in S.VARIANTS]))
    texts = text_signals(files)
    rows = texts.join(counted, FILE, "left").select(*texts.columns, both.alias("_v")).select(*texts.columns, "_v.variant", "_v._s.*")

    def pick(build) -> Column:
        summary, detail = (build(v) for v in S.VARIANTS)
        return F.when(F.col("variant") == "detail", detail).otherwise(summary)
    return (_filled(rows)
            .withColumn("module_purpose", pick(purpose))
            .withColumn("responsibilities", pick(responsibilities))
            .withColumn("confidence", confidence())
            .selectExpr("variant", *PROFILE))
