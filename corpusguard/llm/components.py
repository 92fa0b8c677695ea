"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.session import checkpointed


def _parents(edges: DataFrame) -> DataFrame:
    """v, p: each vertex with its least neighbour, or itself if that is less; then each root found by jumping."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("p")))
    up = checkpointed(both.groupBy("v").agg(F.min("p").alias("p")).select("v", F.least("v", "p").alias("p")))
    while True:
        jumped = checkpointed(up.alias("x").join(up.select(F.col("v").alias("w"), F.col("p").alias("q")).alias("y"), F.col("p") == F.col("w"))
                              .select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
        up = jumped.select("v", "p")
        if jumped.where("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of ``edges`` (a, b, both orderable, without nulls); root is the least vertex reachable.

    Each round hangs every vertex below its least neighbour, follows those links to
    their ends by doubling, and contracts the edges to the ends. An edge's ends
    differ only if both are local minima, so the vertices left at least halve and
    the number of rounds is logarithmic, for long chains too. Counts and minima
    combine before they shuffle, and each join has one row per vertex on one side,
    so a vertex with very many edges is split like any other skewed join.
    """
    left = edges.select("a", "b").where("a <> b").distinct()
    names = None
    while True:
        left = checkpointed(left)
        if left.isEmpty():
            break
        up = _parents(left)
        if names is None:
            names = up.select("v", F.col("p").alias("root"))
        else:
            step = up.select(F.col("v").alias("root"), "p")
            names = checkpointed(names.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root")))
        pa, pb = (up.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b"))
        ends = left.join(pa, "a").join(pb, "b").where("pa <> pb")
        left = ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    return names if names is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
