"""Joins that connect names and paths across files. All of them are equi-joins within a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.functions.skew import lookup_join
from corpusguard.operators.structure import FILE

# What an import path may leave out, in the order it is tried.
IMPORT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs",
                   "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def known_files(discovered: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Distinct (repo, file) of both sides."""
    return discovered.select("repo", "file").unionByName(analyzed.select("repo", "file")).distinct()


def import_base(file: Column, source: Column) -> Column:
    """Folded path of a relative or absolute import; null for a package."""
    return (F.when(source.startswith("/"), T.fold_path(source))
            .when(source.startswith("."), T.fold_path(F.concat(T.parent_directory(file), F.lit("/"), source))))


def import_keys(known: DataFrame) -> DataFrame:
    """The bases under which each file can be imported, best file per base.

    A file has at most three bases, so this replaces eleven candidates per import.
    """
    path = F.col("_path")
    slots = [F.struct(path.alias("base"), F.lit(0).alias("pos"))]
    for pos, suffix in enumerate(IMPORT_SUFFIXES, start=1):
        stem = F.substring(path, F.lit(1), F.length(path) - len(suffix))
        slots.append(F.when(path.endswith(suffix), F.struct(stem.alias("base"), F.lit(pos).alias("pos"))))
    return (known.withColumn("_path", T.forward_slashes(F.col("file")))
            .select("repo", "_path", F.inline(F.array_compact(F.array(*slots))))
            .groupBy("repo", "base").agg(F.min_by("_path", "pos").alias("target")))


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``target``: the known file an import refers to, or null."""
    based = imports.withColumn("base", import_base(F.col("file"), F.col("source")))
    return lookup_join(based, import_keys(known), ["repo", "base"]).drop("base")


def first_bindings(resolved_imports: DataFrame) -> DataFrame:
    """Per file and local name: the first binding whose import resolves."""
    rows = (resolved_imports.where(F.col("target").isNotNull())
            .select(*FILE, "place", "target", F.posexplode("bindings").alias("pos", "_b"))
            .select(*FILE, "place", "pos", "target", "_b.imported", "_b.local"))
    return (rows.groupBy(*FILE, "local")
            .agg(F.min_by(F.struct("imported", "target"), F.struct("place", "pos")).alias("_f"))
            .select(*FILE, "local", "_f.imported", "_f.target"))


def default_export_names(exports: DataFrame) -> DataFrame:
    """First default export of each file, keyed by its forward-slash path."""
    return (exports.where(F.col("type") == "default")
            .groupBy("repo", T.forward_slashes(F.col("file")).alias("target"))
            .agg(F.min_by("name", F.struct("place", "pos")).alias("default_name")))


def with_exported_name(bound: DataFrame, exports: DataFrame) -> DataFrame:
    """Name under which a bound target exports: ``default`` goes through its default export."""
    joined = lookup_join(bound, default_export_names(exports), ["repo", "target"])
    return (joined.withColumn("exported_name", F.when(F.col("imported") == "default", F.col("default_name"))
                              .otherwise(F.col("imported"))).drop("default_name"))


def resolve_bindings(resolved_imports: DataFrame, functions: DataFrame, exports: DataFrame) -> DataFrame:
    """Per file and local name: target file, exported name, and whether that is a function there.

    This is done once per binding, not once per call; calls then only meet their
    own file's bindings, so a module everybody imports is no hot key for them.
    """
    bound = with_exported_name(first_bindings(resolved_imports), exports)
    remote = functions.select("repo", F.col("file").alias("target"), F.col("name").alias("exported_name"),
                              F.lit(True).alias("is_remote")).distinct()
    found = lookup_join(bound, remote, ["repo", "target", "exported_name"])
    return found.select(*FILE, "local", "target", "exported_name", F.coalesce("is_remote", F.lit(False)).alias("is_remote"))


def resolve_calls(edges: DataFrame, functions: DataFrame, resolved_bindings: DataFrame) -> DataFrame:
    """Where each call edge leads: a local function, an imported one, or an external name."""
    local = functions.select(*FILE, F.col("name").alias("callee"), F.lit(True).alias("is_local"))
    bound = resolved_bindings.withColumnRenamed("local", "callee")
    placed = (edges.join(local, [*FILE, "callee"], "left").join(bound, [*FILE, "callee"], "left")
              .withColumn("is_local", F.coalesce("is_local", F.lit(False))))
    imported = ~F.col("is_local") & F.col("target").isNotNull()
    reached = imported & F.col("is_remote")
    return placed.select(
        *FILE, "caller", "callee", "ord", "is_local", F.when(imported, F.col("target")).alias("target_file"),
        F.when(reached, F.col("exported_name")).otherwise(F.col("callee")).alias("target_name"),
        (F.col("is_local") | reached).alias("resolved"))


def request_path(file: Column, path: Column) -> Column:
    """Folded path of a literal request: no query, no fragment, no host; relative to the caller's folder."""
    cut = F.regexp_extract(path, r"^[^?#]*", 0)
    bare = F.when(cut.rlike("(?i)^https?://"), F.concat(F.lit("/"), F.regexp_replace(cut, r"(?i)^https?://[^/]*/?", ""))).otherwise(cut)
    return T.fold_path(F.when(bare.startswith("/"), bare).otherwise(F.concat(T.parent_directory(file), F.lit("/"), bare)))


def path_endings(known: DataFrame) -> DataFrame:
    """Every trailing part of every known path, with how many files share it.

    Counted before any join, so an ending that a third of all files share is one
    row, and it is dropped at once unless it is a full path.
    """
    folded = known.withColumn("_path", T.fold_path(F.col("file"))).withColumn("_parts", F.split("_path", "/"))
    ends = folded.select("repo", "_path", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("_parts")),
        lambda i: F.array_join(F.slice("_parts", i, F.size("_parts") - i + 1), "/"))).alias("_pos", "ending"))
    return (ends.groupBy("repo", "ending").agg(
        F.bool_or(F.col("_pos") == 0).alias("_whole"), F.count_if(F.col("_pos") > 0).alias("_shared"),
        F.min(F.when(F.col("_pos") > 0, F.col("_path"))).alias("_path"))
        .where(F.col("_whole") | (F.col("_shared") == 1))
        .select("repo", "ending", F.when(F.col("_whole"), F.col("ending")).otherwise(F.col("_path")).alias("target")))


def resolve_file_calls(file_calls: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``target``: the file with exactly this path, else the only file that ends with it."""
    asked = file_calls.withColumn("ending", request_path(F.col("file"), F.col("path")))
    return lookup_join(asked, path_endings(known), ["repo", "ending"]).drop("ending")
