"""What other jobs use of this library: scans, policies, reports, tables.

Detectors take their options as keywords: pass scan() a dict of detectors with, for example,
partial(ghost_deps.detect, min_age_days=30)."""

from corpusward.detectors import ai_presence, ai_unreviewed, crypto, env_leak, ghost_deps, secrets, sinks, supply_chain
from corpusward.corpus import corpus_report, run_corpus
from corpusward.operators.references import decisions
from corpusward.operators.registry import as_of, earliest_release
from corpusward.operators.scoring import BANDS, WEIGHTS, band, gate, trust_scores
from corpusward.policy import Policy, load, parse
from corpusward.scan import DETECTORS, Result, changed_only, scan, scan_folders, select, with_policy
from corpusward.schemas import FINDING, ISSUE, Found, Tables, findings, with_text
from corpusward.sinks.reports import badge, corpus, page, sarif, terminal
from corpusward.sources.tree import read_trees
from corpusward.streaming.files import file_stream, findings_stream

__all__ = [
    "BANDS", "DETECTORS", "FINDING", "ISSUE", "WEIGHTS", "Found", "Policy", "Result", "Tables",
    "ai_presence", "ai_unreviewed", "as_of", "badge", "band", "changed_only", "corpus", "corpus_report", "crypto", "decisions", "earliest_release", "env_leak", "file_stream", "findings", "findings_stream", "gate",
    "ghost_deps", "load", "page", "parse", "read_trees", "run_corpus", "sarif", "scan", "scan_folders", "secrets", "select", "sinks", "supply_chain", "terminal", "trust_scores", "with_policy",
    "with_text",
]
