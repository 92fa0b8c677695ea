"""The line scan: rules routed by file type, unrolled as literal patterns.

The scan is one narrow stage. A file is dropped when its text holds none of the
stems of its rules; its lines are exploded next to the line array (inside one
code-generated stage the array is only a reference, it is copied for lines that
survive the filters); a line is dropped when it holds no stem, is a comment or
carries the suppression mark; only then do the rules run, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.rules import GENERIC_COMMAND_TITLES, SPECIFIC_COMMAND_MARK, Rule, RuleSet


def route(files: DataFrame, rules: RuleSet) -> DataFrame:
    """File types to the rules that run on them. The bridge has at most rules x extensions rows."""
    spark = files.sparkSession
    return (files.join(F.broadcast(rules.extension_table(spark)), "file_type")
            .join(F.broadcast(rules.table(spark).select("rule_id", "rule_ord")), "rule_id"))


def by_language(rules: RuleSet, build) -> Column:
    """A case per group of file types; ``build`` makes the branch from that group's rules."""
    out = None
    for extensions, group in rules.groups():
        test = F.col("file_type").isin(*extensions)
        out = F.when(test, build(group)) if out is None else out.when(test, build(group))
    return out


def has_stem(column: str, group) -> Column:
    """Necessary condition for a hit of any rule of ``group``: plain words first, patterns only behind them."""
    if not all(r.stem or r.stem_pattern for r in group):
        return F.lit(True)

    def any_word(rules) -> Column:
        words = dict.fromkeys(w for r in rules for w in r.stem.split("|") if w)
        quoted = [w.replace("\\", "\\\\").replace("'", "\\'") for w in words]
        return F.expr(" OR ".join(f"contains(`{column}`, '{w}')" for w in quoted) or "false")
    test = any_word([r for r in group if not r.stem_pattern])
    for rule in group:
        if rule.stem_pattern:
            found = F.col(column).rlike("(?i)" + rule.stem_pattern)
            test = test | (any_word([rule]) & found if rule.stem else found)
    return test


def has_stem_at_once(text: Column, group) -> Column:
    """The same for a whole text, as one pattern.

    A text mostly holds some stem early on, so one pass that stops there is as fast
    as the words; and a computed text is then named once, not once per word.
    """
    if not all(r.stem or r.stem_pattern for r in group):
        return F.lit(True)
    words = dict.fromkeys(w for r in group if not r.stem_pattern for w in r.stem.split("|") if w)
    patterns = [T.alternatives(words)] if words else []
    return text.rlike("(?i)" + "|".join(patterns + [r.stem_pattern for r in group if r.stem_pattern]))


def may_match(column: str, rules: RuleSet, whole: bool = False) -> Column:
    """Necessary condition for a hit of the rules of the row's language, on a line or a whole text."""
    test = (lambda group: has_stem_at_once(F.col(column), group)) if whole else (lambda group: has_stem(column, group))
    return F.coalesce(by_language(rules, test), F.lit(False))


def match(line: Column, rule: Rule) -> Column:
    """The reported text of ``rule`` on ``line`` before trimming, empty for no hit."""
    found = F.regexp_extract(line, rule.pattern, 1)
    if rule.unless_pattern is None:
        return found
    excused = F.regexp_count(line, F.lit(rule.unless_pattern))
    return F.when(F.regexp_count(line, F.lit(rule.pattern)) > excused, found).otherwise(F.lit(""))


def is_shadowed(rules: RuleSet) -> Column:
    """A generic command hit on a line that a specific command rule also hits."""
    def branch(group):
        slots = [i for i, r in enumerate(group) if SPECIFIC_COMMAND_MARK in r.title]
        generic = [r.rule_id for r in group if r.title in GENERIC_COMMAND_TITLES]
        if not slots or not generic:
            return F.lit(False)
        return F.col("rule_id").isin(*generic) & (F.concat(*[F.col("_found")[i] for i in slots]) != "")
    return F.coalesce(by_language(rules, branch), F.lit(False))


def candidate_lines(files: DataFrame, rules: RuleSet, prefilter: bool = True) -> DataFrame:
    """Lines the rules have to look at, with their file's line array still at hand."""
    keep = [c for c in files.columns if c != "content"]
    wanted = files.where(may_match("content", rules, whole=True)) if prefilter else files
    # the outer form keeps Spark from testing the array first, which would split the text twice
    exploded = (wanted.select(*keep, T.split_lines(F.col("content")).alias("_lines"))
                .select(*keep, "_lines", F.posexplode_outer("_lines").alias("_pos", "line")))
    line = F.col("line")
    if prefilter:
        exploded = exploded.where(may_match("line", rules))
    return exploded.where(~T.is_suppressed(line) & ~T.is_comment(line))


def hits(files: DataFrame, rules: RuleSet, suppress: bool = True, prefilter: bool = True) -> DataFrame:
    """One row per (line, rule) that matches: rule_id, matched, code, context."""
    keep = [c for c in files.columns if c != "content"]
    line = F.col("line")
    tested = candidate_lines(files, rules, prefilter).withColumn(
        "_found", by_language(rules, lambda g: F.array(*[match(line, r) for r in g])))
    found = (tested.select("*", F.posexplode_outer("_found").alias("_slot", "_text")).where(F.col("_text") != "")
             .withColumn("rule_id", by_language(rules, lambda g: F.array(*[F.lit(r.rule_id) for r in g])[F.col("_slot")])))
    if suppress:
        found = found.where(~is_shadowed(rules))
    return found.select(
        *keep, (F.col("_pos") + 1).alias("line"), T.snippet(line).alias("code"),
        T.context_window(F.col("_lines"), F.col("_pos")).alias("context"),
        "rule_id", T.full_trim(F.col("_text")).alias("matched"))


def with_rule_columns(hits_df: DataFrame, rules: RuleSet, *columns: str) -> DataFrame:
    """Attach rule attributes; the dimension is size-checked by RuleSet."""
    return hits_df.join(F.broadcast(rules.table(hits_df.sparkSession).select("rule_id", *columns)), "rule_id")


def with_finding_id(hits_df: DataFrame) -> DataFrame:
    return hits_df.withColumn("id", F.concat_ws(":", "file", F.col("line").cast("string"), "title", "matched"))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in reading order: input order, line, rule."""
    return findings.orderBy("repo", "seq", "line", "rule_ord")


def single_rule_hits(texts: DataFrame, text: str, rule: Rule) -> DataFrame:
    """One rule over any text column, without routing by file type."""
    keep = [c for c in texts.columns if c != text]
    body = F.col(text)
    line = F.col("line")
    return (texts.where(has_stem_at_once(body, [rule])).select(*keep, F.posexplode_outer(T.split_lines(body)).alias("_pos", "line"))
            .where(~T.is_suppressed(line) & ~T.is_comment(line))
            .where(match(line, rule) != "")
            .select(*keep, (F.col("_pos") + 1).alias("line_no"), T.full_trim(match(line, rule)).alias("matched"),
                    T.snippet(line).alias("code")))
