"""Reports: terminal text, SARIF, HTML, corpus summary. files.py writes those of many repositories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusward.operators import scoring
from corpusward.operators.references import first_by
from corpusward.operators.scoring import WEIGHTS
from corpusward.scan import Result
from corpusward.sinks import files
from corpusward.sinks.files import badge
from corpusward.sinks.rules import rule_id


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule, title, explanation: of the first finding of each rule."""
    return first_by(findings.withColumn("rule", rule_id()), ["rule"], [F.col("id"), F.col("file"), F.col("line")]).select("rule", "title", "explanation")


def _mine(result: Result, repo_id: str):
    return result.sorted_findings().where(F.col("repo_id") == repo_id).withColumn("rule", rule_id()).toLocalIterator()


def sarif(result: Result, repo_id: str) -> dict:
    """SARIF 2.1.0 of one repository."""
    return json.loads("".join(files.sarif_text(_mine(result, repo_id))))


def page(result: Result, repo_id: str, score: int) -> str:
    """All findings of one repository as HTML."""
    return "".join(files.page_text(repo_id, score, _mine(result, repo_id)))


def file_rows(result: Result, gated: DataFrame) -> DataFrame:
    """What files.write takes."""
    return files.report_rows(result.findings, gated, scoring.finding_order(F.col("severity"), F.col("detector_id"), F.col("file"), F.col("line")))


def _top(rows: DataFrame, order: list, most: int, *columns: str) -> DataFrame:
    """repo_id, n (rows) and top: the first `most` of each repository's rows. Only these are collected."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)).alias("_place")
    first = rows.select("repo_id", *columns, place).where(F.col("_place") <= most)
    listed = first.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("_place", *columns))).alias("top"))
    return rows.groupBy("repo_id").agg(F.count("*").alias("n")).join(listed, "repo_id")


def terminals(result: Result, gated: DataFrame, top: int = 5, most_issues: int = 20) -> DataFrame:
    """gated with what a terminal shows of each repository: ghosts, found and issued, each with n and top."""
    order = [*scoring.finding_order(F.col("severity"), F.col("detector_id"), F.col("file"), F.col("line")), F.col("id")]
    shown = ["severity", "title", "file", "line"]
    parts = {
        "ghosts": _top(ghosts(result.findings), order, top, *shown),
        "found": _top(result.findings.where("severity <> 'info'"), order, top, *shown),
        "issued": _top(result.issues, [F.col(c) for c in ("detector_id", "code", "message", "file")], most_issues, "detector_id", "message"),
    }
    for name, some in parts.items():
        gated = gated.join(some.select("repo_id", F.struct("n", "top").alias(name)), "repo_id", "left")
    return gated


def terminal_text(row) -> str:
    """A short text of a row of terminals: status, ghost packages, the first findings, issues."""
    out = [f"{row.status}  trust score {row.trust_score}/100  " + ", ".join(f"{row[x]} {x}" for x in WEIGHTS if row[x])]
    out += [f"  - {r}" for r in row.reasons]
    if row.ghosts:
        out.append(f"ghost packages: {row.ghosts.n}")
        out += [f"  {f.title} ({f.file}:{f.line})" for f in row.ghosts.top]
    out += [f"[{f.severity}] {f.title} ({f.file or '-'}{':' + str(f.line) if f.line else ''})" for f in (row.found.top if row.found else [])]
    if row.issued:
        out += [f"! {i.detector_id}: {i.message}" for i in row.issued.top]
        if (hidden := row.issued.n - len(row.issued.top)) > 0:
            out.append(f"! and {hidden} more")
    return "\n".join(out)


def terminal(result: Result, gated: DataFrame, repo_id: str) -> str:
    """What a terminal shows of one repository."""
    return terminal_text(terminals(result, gated).where(F.col("repo_id") == repo_id).first())


def ghosts(findings: DataFrame) -> DataFrame:
    """Findings of packages that don't exist or imitate another, with in_docs."""
    ghost = findings.where((F.col("detector_id") == "ghost-deps") & F.col("id").rlike("nonexistent|typosquat"))
    return ghost.withColumn("in_docs", F.get_json_object("metadata", "$.source") == "docs")


def patterns(findings: DataFrame) -> DataFrame:
    """repo_id, detector_id, pattern, n: how often each rule was found."""
    return findings.groupBy("repo_id", "detector_id", rule_id().alias("pattern")).agg(F.count("*").alias("n")).orderBy("repo_id", "detector_id", F.desc("n"), "pattern")


def corpus(result: Result) -> DataFrame:
    """scanned, affected, rate (percent), ghosts, in_docs over all repositories."""
    return corpus_counts(result.repos, ghosts(result.findings))


def corpus_counts(repos: DataFrame, ghost: DataFrame, *by: str) -> DataFrame:
    """by (columns of repos), scanned, affected, rate, ghosts, in_docs, from repos (repo_id) and their
    ghost findings (repo_id, in_docs)."""
    by_repo = ghost.groupBy("repo_id").agg(F.count("*").alias("ghosts"), F.count_if("in_docs").alias("in_docs"))
    joined = repos.join(by_repo, "repo_id", "left").fillna(0, ["ghosts", "in_docs"])
    made = joined.groupBy(*by).agg(F.count("*").alias("scanned"), F.count_if(F.col("ghosts") > 0).alias("affected"), F.sum("ghosts").alias("ghosts"), F.sum("in_docs").alias("in_docs"))
    return made.withColumn("rate", F.round(100 * F.col("affected") / F.greatest("scanned", F.lit(1)), 1))
