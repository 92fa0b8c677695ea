"""Corpus to findings, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusguard.operators import enrich, prepare, scan
from corpusguard.rules import RuleSet

COLUMNS = ("repo", "file", "seq", "file_type", "id", "line", "rule_id", "rule_ord", "severity", "weight", "title",
           "matched", "code", "context", "source", "security_story", "story_confidence", "scenario", "attack_chain")


def build_findings(corpus: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """One narrow stage from the scan of the corpus to finished findings: no shuffle."""
    rules = rules or RuleSet()
    files = prepare.analyzable(corpus, rules.extensions)
    found = scan.hits(files, rules)
    described = scan.with_rule_columns(found, rules, "rule_ord", "title", "severity", "weight",
                                       "story", "scenario_template")
    return enrich.enrich(scan.with_finding_id(described)).select(*COLUMNS)
