"""What a finding means: taint source, entry, sink, confidence, story and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.rules import (
    DEFAULT_SOURCE, DEFAULT_STORY_HEAD, ENTRY_LADDER, FUNCTION_HEADER, MEDIUM_TITLE_PARTS, MEDIUM_TITLES,
    SEVERITY_WEIGHTS, SINK, SOURCE_STEMS, SOURCE_WORDS, SOURCES, RuleSet,
)


def source_label(context: Column, matched: Column) -> Column:
    """First pattern in list order, on the context, then on the reported text.

    The reported text is part of the context, so contexts without any stem skip all patterns.
    A pattern runs only where its own word is found, and none runs behind the first that hits.
    """
    stem = F.lit(False)
    for word in SOURCE_STEMS:
        stem = stem | context.contains(word)
    found = [F.when(c.contains(word), T.first_group(c, p)) for c in (context, matched) for p, word in zip(SOURCES, SOURCE_WORDS)]
    return F.when(stem, F.coalesce(*found))


def entry_point(source: Column) -> Column:
    ladder = F.when(source.isNull(), F.lit(DEFAULT_STORY_HEAD))
    for pattern, entry, _ in ENTRY_LADDER:
        ladder = ladder.when(source.rlike("(?i)" + pattern), F.lit(entry))
    return ladder.otherwise(F.lit(DEFAULT_STORY_HEAD))


def entry_evidence(source: Column) -> Column:
    ladder = F.when(source.isNull(), F.lit(None).cast("string"))
    for pattern, _, evidence in ENTRY_LADDER:
        ladder = ladder.when(source.rlike("(?i)" + pattern), F.lit(evidence))
    return ladder.otherwise(source)


def sink_evidence(matched: Column) -> Column:
    return T.first_group(matched, SINK)


def confidence(title: Column, source: Column, context: Column) -> Column:
    medium = title.isin(*MEDIUM_TITLES)
    for part in MEDIUM_TITLE_PARTS:
        medium = medium | title.contains(part)
    return (F.when(source.isNotNull(), F.lit("High"))
            .when(context.rlike(FUNCTION_HEADER) | medium, F.lit("Medium"))
            .otherwise(F.lit("Low")))


def security_story(story: Column, source: Column) -> Column:
    return F.when(source.isNull(), story).otherwise(
        F.concat(F.array(source), F.slice(story, F.lit(2), F.greatest(F.size(story) - 1, F.lit(0)))))


def scenario(template: Column, source: Column) -> Column:
    return F.replace(template, F.lit("{src}"), F.coalesce(source, F.lit(DEFAULT_SOURCE)))


def attack_chain(story: Column, source: Column, matched: Column, file: Column, line: Column) -> Column:
    return F.struct(
        entry_point(source).alias("entry"),
        entry_evidence(source).alias("entry_evidence"),
        story[1].alias("sink"),
        sink_evidence(matched).alias("sink_evidence"),
        story[2].alias("impact"),
        F.concat_ws(":", file, line.cast("string")).alias("location"),
    )


def enrich(hits: DataFrame) -> DataFrame:
    """Add the derived columns to hits that carry the rule's title, story and scenario_template."""
    with_source = hits.withColumn("source", source_label(F.col("context"), F.col("matched")))
    source, story = F.col("source"), F.col("story")
    return (with_source
            .withColumn("attack_chain", attack_chain(story, source, F.col("matched"), F.col("file"), F.col("line")))
            .withColumn("story_confidence", confidence(F.col("title"), source, F.col("context")))
            .withColumn("scenario", scenario(F.col("scenario_template"), source))
            .withColumn("security_story", security_story(story, source))
            .drop("story", "scenario_template"))


def explain(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """Attach why, impact and fix by title; unknown titles keep nulls."""
    texts = rules.table(findings.sparkSession).select("title", "why", "impact", "fix")
    return findings.join(F.broadcast(texts.dropDuplicates(["title"])), "title", "left")


def with_weight(findings: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for item in SEVERITY_WEIGHTS.items() for x in item]
    return findings.withColumn("weight", F.element_at(F.create_map(*pairs), F.col("severity")))
