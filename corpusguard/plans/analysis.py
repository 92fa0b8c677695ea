"""Whole analysis of a corpus: findings, metadata, module and repository summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from corpusguard.operators import aggregate as A, payload as P, prepare, rank, roles, structure as S
from corpusguard.plans.findings import build_findings
from corpusguard.plans.metadata import build_metadata
from corpusguard.rules import RuleSet
from corpusguard.session import materialized


@dataclass(frozen=True)
class AnalysisResult:
    """Findings and structure lines of a corpus, and the summaries over them, planned on first use.

    The findings, the structure lines and the profiles, which several summaries read, are
    written once to shared storage when first asked for, unless ``materialize`` is off.
    """

    corpus: DataFrame
    files: DataFrame
    rules: RuleSet
    materialize: bool = True

    def _once(self, rows: DataFrame, label: str) -> DataFrame:
        return materialized(rows, label) if self.materialize else rows

    @cached_property
    def input_counts(self) -> DataFrame:
        return A.input_counts(self.corpus)

    @cached_property
    def findings(self) -> DataFrame:
        return self._once(build_findings(self.corpus, self.rules), "findings")

    @cached_property
    def events(self) -> DataFrame:
        return self._once(S.events(self.files), "events")

    @cached_property
    def signals(self) -> DataFrame:
        """What the summaries read of the structure lines: the lines themselves if they were asked for before, else a cheaper scan."""
        known = self.__dict__
        return known["events"] if "events" in known else self._once(S.signal_facts(self.files), "signals")

    @cached_property
    def profiles(self) -> DataFrame:
        """Read by metadata, modules, repositories and payloads."""
        return self._once(roles.profiles(self.files, self.signals), "profiles")

    @cached_property
    def metadata(self) -> DataFrame:
        events = self.events    # before the profiles, which then read them too
        return build_metadata(self.files, self.findings, events, profiles=self.profiles)

    @cached_property
    def modules(self) -> DataFrame:
        return rank.modules_in_order(A.modules(self.profiles, self.findings, self.signals))

    @cached_property
    def repos(self) -> DataFrame:
        # only counts the files: roles are not told for that
        counted = self.__dict__.get("profiles", self.files)
        return A.repo_totals(self.input_counts, counted, self.findings, self.signals)

    @cached_property
    def hotspots(self) -> DataFrame:
        return rank.hotspots(A.file_risk(self.findings))


def analyze(corpus: DataFrame, rules: RuleSet | None = None, materialize: bool = True) -> AnalysisResult:
    """Analyze a corpus of (repo, file, content, seq)."""
    rules = rules or RuleSet()
    return AnalysisResult(corpus, prepare.analyzable(corpus, rules.extensions), rules, materialize)


def first_details(result: AnalysisResult) -> tuple[DataFrame, DataFrame]:
    """Metadata of the first files of each repository, and the findings in them.

    The files are chosen by path first; only their details are put together. What the result has
    already written is read, else only the chosen files are scanned.
    """
    known = result.__dict__
    few = result._once(rank.first_files(result.files.select("repo", "file", "seq")).drop("rank"), "few")
    paths = few.select("repo", "file").distinct()
    # written, as tests on contents would go before the join and so run on every file
    chosen = result._once(result.corpus.join(paths, ["repo", "file"], "left_semi"), "chosen")
    files = prepare.analyzable(chosen, result.rules.extensions).join(few, S.FILE, "left_semi")
    events = result._once(known["events"].join(few, S.FILE, "left_semi") if "events" in known else S.events(files), "events")
    findings = result._once(known["findings"].join(paths, ["repo", "file"], "left_semi") if "findings" in known
                            else build_findings(chosen, result.rules), "findings")
    profiles = known["profiles"].join(few, S.FILE, "left_semi") if "profiles" in known else None
    return build_metadata(files, findings, events, profiles=profiles), findings


def compact_payloads(result: AnalysisResult) -> DataFrame:
    modules, repos = P.payload_modules(result.modules), result.repos
    return P.compact_payload(repos, result.hotspots, modules, P.payload_files(*first_details(result)))


def analyze_text(spark: SparkSession, path: str, text: str, rules: RuleSet | None = None) -> AnalysisResult:
    """Paste mode: one text under one path."""
    from corpusguard.sources.readers import CORPUS_SCHEMA
    return analyze(spark.createDataFrame([("pasted", path, text, 0)], CORPUS_SCHEMA), rules)
