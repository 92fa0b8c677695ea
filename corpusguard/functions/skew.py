"""Joins and numbering that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.session import materialized

#: Rows of one key that one task may take.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and ``_salts``, the tasks that each is dealt to, rising with its rows.

    Counts are combined on the map side, so even the hottest key costs one row per
    task. There are at most rows / hot_rows such keys, a millionth of the rows.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    return counts.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``left`` to ``right`` (unique on ``on``), spreading keys that are hot on the left.

    One plan for every size. ``left`` is written once, as it is read for the counts
    and for the join. Rows with a null key match nothing and do not travel. The rows
    of a hot key are dealt to as many tasks as its count asks for, and its one row on
    the right is repeated for each; all other keys have one task.
    """
    left = materialized(left, "lookup")
    named = F.lit(True)
    for c in on:
        named = named & F.col(c).isNotNull()
    hot = hot_keys(left.where(named), on, hot_rows)
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t]), F.coalesce("_salts", F.lit(1))).cast("int")
    salted_left = left.where(named).join(F.broadcast(hot), on, "left").withColumn("_salt", deal).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    joined = salted_left.join(salted_right, [*on, "_salt"], "left").drop("_salt")
    return joined.unionByName(left.where(~named), allowMissingColumns=True)


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of each row within ``group``, in the order of the columns ``order``, by a distributed prefix sum.

    Rows are dealt by ranges of (group, order) with sampled bounds, so a group of any size is spread over as many ranges as
    it needs, and each task sorts its own. A range's rows carry their place in it; a range and group has one row of counts,
    and the sum of a group's counts in earlier ranges shifts its rows. So no window runs over more rows than there are ranges.
    Only rows equal in all these columns must share a range.
    """
    keys = [*group, *order]
    # ids grow by one within a task, and are written with the rows, so that they stay as they are
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialized(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("l._range") == F.col("r._range")
    for c in group:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    numbered = ranged.alias("l").join(starts.alias("r"), same).select("l.*", F.col("r._shift").alias("_shift"))
    return numbered.withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint")).drop("_range", "_at", "_shift")


def first_distinct(df: DataFrame, group: list[str], value: str, order: list[str], limit: int,
                   name: str) -> DataFrame:
    """Distinct non-empty values per group in first-seen order, as an array of at most ``limit``.

    Values are deduplicated with a combinable min before anything is ranked, and
    the rank filter lets Spark trim each group before its shuffle.
    """
    seen = (df.where(F.col(value).isNotNull() & (F.col(value) != ""))
            .groupBy(*group, value).agg(F.min(F.struct(*order)).alias("_first")))
    rank = Window.partitionBy(*group).orderBy("_first", value)
    seen = seen.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_first"), F.col(value).alias("_value"))))
    return seen.groupBy(*group).agg(F.transform(pairs, lambda p: p["_value"]).alias(name))
