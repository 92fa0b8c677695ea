"""Source-corpus security analytics on Spark."""

from corpusguard.plans.analysis import AnalysisResult, analyze, analyze_text, compact_payloads
from corpusguard.plans.callflow import CallFlow, build_call_flow
from corpusguard.plans.findings import build_findings
from corpusguard.plans.metadata import build_metadata
from corpusguard.rules import Rule, RuleSet, register_rules
from corpusguard.session import build_session
from corpusguard.sources.readers import read_corpus, read_tree
from corpusguard.sources.writers import write_results

__all__ = ["AnalysisResult", "CallFlow", "Rule", "RuleSet", "analyze", "analyze_text", "build_call_flow",
           "build_findings", "build_metadata", "build_session", "compact_payloads", "read_corpus", "read_tree",
           "register_rules", "write_results"]
