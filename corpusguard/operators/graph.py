"""The call-flow graph of each repository: nodes, edges, ranks, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.functions.skew import lookup_join, number_rows
from corpusguard.operators.structure import FILE, ROOT
from corpusguard.session import bucketed, checkpointed

NODE_CAP, EDGE_CAP = 180, 320
COLUMN_WIDTH, ROW_HEIGHT = 250, 105
MODULE = "<module>"
COMPACT_EVERY = 16


def place(phase: int, line: Column, pos: Column, sub: int) -> Column:
    """Position of a node or edge in the order the graph is built."""
    return F.struct(F.lit(phase).alias("phase"), F.col("seq"), F.col("file"),
                    line.cast("int").alias("line"), pos.cast("int").alias("pos"), F.lit(sub).alias("sub"))


def function_id(file: Column, name: Column) -> Column:
    return F.concat(F.lit("function:"), file, F.lit(":"), name)


def with_caller(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls whose caller is a function of the file, or the module itself."""
    named = functions.select(*FILE, F.col("name").alias("caller"), F.lit(True).alias("_known"))
    known = F.coalesce("_known", F.lit(False))
    return (calls.join(named, [*FILE, "caller"], "left").where(known | (F.col("caller") == ROOT))
            .withColumn("from_module", ~known)
            .withColumn("source", function_id(F.col("file"), F.when(known, F.col("caller")).otherwise(F.lit(MODULE))))
            .drop("_known"))


def call_links(resolved_calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Call edges with their target node."""
    owner = F.coalesce("target_file", "file")
    target = (F.when(F.col("resolved"), function_id(owner, F.col("target_name")))
              .otherwise(F.concat(F.lit("external:"), owner, F.lit(":"), F.col("target_name"))))
    return with_caller(resolved_calls, functions).select(
        *FILE, "source", "from_module", target.alias("target"), F.col("target_name").alias("name"),
        owner.alias("file_path"), F.when(F.col("resolved"), F.lit("function")).otherwise(F.lit("external")).alias("kind"),
        F.lit(None).cast("string").alias("label"), "resolved",
        F.lit(1).alias("phase"), F.col("ord.place").alias("line"), F.col("ord.pos").alias("pos"))


def file_links(resolved_file_calls: DataFrame, functions: DataFrame, analyzed: DataFrame) -> DataFrame:
    """HTTP edges; they count as resolved when the target file is analyzed."""
    done = analyzed.select("repo", T.forward_slashes(F.col("file")).alias("target"), F.lit(True).alias("_done")).distinct()
    rows = lookup_join(with_caller(resolved_file_calls, functions), done, ["repo", "target"])
    hit = F.coalesce("_done", F.lit(False))
    shown = F.coalesce("target", "path")
    return rows.select(
        *FILE, "source", "from_module",
        F.when(F.col("target").isNotNull(), F.concat(F.lit("file:"), F.col("target")))
        .otherwise(F.concat(F.lit("external:"), F.col("file"), F.lit(":"), F.col("path"))).alias("target"),
        T.base_name(shown).alias("name"), shown.alias("file_path"),
        F.when(hit, F.lit("file")).otherwise(F.lit("external")).alias("kind"), F.lit("HTTP").alias("label"),
        hit.alias("resolved"), F.lit(2).alias("phase"), F.col("place").alias("line"), F.lit(0).alias("pos"))


def nodes(functions: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct nodes; the first mention decides, ``node_ord`` keeps its place."""
    def ordered(sub: int) -> Column:
        return F.struct("phase", "seq", "file", F.col("line").cast("int").alias("line"),
                        F.col("pos").cast("int").alias("pos"), F.lit(sub).alias("sub"))
    of_functions = functions.select(
        "repo", function_id(F.col("file"), F.col("name")).alias("id"), "name", F.col("file").alias("file_path"),
        F.lit("function").alias("kind"), place(0, F.col("place"), F.lit(0), 0).alias("node_ord"))
    of_modules = links.where("from_module").select(
        "repo", F.col("source").alias("id"), F.lit("module").alias("name"), F.col("file").alias("file_path"),
        F.lit("function").alias("kind"), ordered(0).alias("node_ord"))
    of_targets = links.select("repo", F.col("target").alias("id"), "name", "file_path", "kind", ordered(1).alias("node_ord"))
    every = of_functions.unionByName(of_modules).unionByName(of_targets)
    return (every.groupBy("repo", "id")
            .agg(F.min_by(F.struct("name", "file_path", "kind"), "node_ord").alias("_n"), F.min("node_ord").alias("node_ord"))
            .select("repo", "id", "_n.name", "_n.file_path", "_n.kind", "node_ord"))


def edges(links: DataFrame) -> DataFrame:
    """Distinct (source, target); a call edge comes before an equal HTTP edge."""
    order = F.struct("phase", "seq", "file", "line", "pos")
    return (links.groupBy("repo", "source", "target")
            .agg(F.min_by(F.struct("label", "resolved"), order).alias("_e"), F.min(order).alias("edge_ord"))
            .select("repo", F.concat("source", F.lit("->"), "target").alias("id"), "source", "target",
                    "_e.label", "_e.resolved", "edge_ord"))


def cap(nodes_df: DataFrame, edges_df: DataFrame, max_nodes: int = NODE_CAP, max_edges: int = EDGE_CAP):
    """First nodes, and first edges between them, plus a truncated flag per repository."""
    def first(df, order, limit):
        w = Window.partitionBy("repo").orderBy(order, "id")
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    few = first(nodes_df, "node_ord", max_nodes)
    ids = few.select("repo", "id")
    inside = (edges_df.join(ids.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi")
              .join(ids.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi"))
    kept = first(inside, "edge_ord", max_edges)
    counts = (nodes_df.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
              .join(edges_df.groupBy("repo").agg(F.count(F.lit(1)).alias("_e")), "repo", "left"))
    flag = counts.select("repo", ((F.col("_n") > max_nodes) | (F.coalesce("_e", F.lit(0)) > max_edges)).alias("truncated"))
    return few, kept, flag


def totals(functions: DataFrame, nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """Per repository: functions, nodes, edges, entry nodes and the largest in-degree."""
    degree = edges_df.groupBy("repo", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    of_nodes = (nodes_df.select("repo", "id").join(degree, ["repo", "id"], "left").groupBy("repo").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("in_degree").isNull()).alias("entry_nodes"),
        F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree")))
    of_edges = edges_df.groupBy("repo").agg(F.count(F.lit(1)).alias("edge_count"))
    of_functions = functions.groupBy("repo").agg(F.count(F.lit(1)).alias("total_functions"))
    return (of_nodes.join(of_edges, "repo", "left").join(of_functions, "repo", "left")
            .fillna(0, ["edge_count", "total_functions"]))


def in_degrees(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    degree = edges_df.groupBy("repo", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes_df.select("repo", "id").join(degree, ["repo", "id"], "left").fillna(0, ["in_degree"])


def ranks(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """Hops from the nearest node without incoming edges; nodes never reached come last.

    The edges are bucketed by source once, so a round reads them in place. A round
    joins the frontier with its out-edges, removes duplicates before the shuffle and
    drops what is ranked, for which the ids ranked so far are shuffled as well. There
    are as many rounds as the graph is deep. Rounds are checkpointed on shared
    storage; the loop ends with an empty frontier.
    """
    ids = checkpointed(nodes_df.select("repo", "id"))
    steps = bucketed(edges_df.select("repo", "source", "target"), "repo", "source")
    targets = steps.select("repo", F.col("target").alias("id")).distinct()
    frontier = checkpointed(ids.join(targets, ["repo", "id"], "left_anti"))
    seen = frontier.withColumn("rank", F.lit(0))
    depth = 0
    while True:
        depth += 1
        reached = (steps.join(frontier.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi")
                   .select("repo", F.col("target").alias("id")).distinct()
                   .join(seen.select("repo", "id"), ["repo", "id"], "left_anti"))
        frontier = checkpointed(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("rank", F.lit(depth)))
        if depth % COMPACT_EVERY == 0:
            seen = checkpointed(seen)
    deepest = seen.groupBy("repo").agg(F.max("rank").alias("_deepest"))
    rest = lookup_join(ids.join(seen.select("repo", "id"), ["repo", "id"], "left_anti"), deepest, ["repo"])
    last = rest.select("repo", "id", (F.coalesce("_deepest", F.lit(0)) + 1).alias("rank"))
    return seen.unionByName(last)


def layout(nodes_df: DataFrame, ranks_df: DataFrame) -> DataFrame:
    """Grid position: a column per rank, rows in node order."""
    placed = nodes_df.join(ranks_df, ["repo", "id"])
    rows = number_rows(placed, ["repo", "rank"], ["node_ord", "id"], "row")
    return rows.select("repo", "id", "rank", "row", (F.col("rank") * COLUMN_WIDTH).cast("bigint").alias("x"),
                       (F.col("row") * ROW_HEIGHT).cast("bigint").alias("y"))
