"""The tables that detectors read and return."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "repo_id string, id string, detector_id string, severity string, title string, explanation string, fix_prompt string, file string, line int, col int, evidence string, metadata string"
ISSUE = "repo_id string, detector_id string, code string, message string, file string"
_FINDING_COLUMNS = [x.split()[0] for x in FINDING.split(", ")]
_FINDING_KINDS = dict(x.split() for x in FINDING.split(", "))


def findings(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """rows as findings; columns that aren't given are taken from rows if there, else null. Plain
    strings are literals."""
    out = []
    for name in _FINDING_COLUMNS:
        value = columns.get(name)
        if value is None:
            value = F.col(name) if name in rows.columns else F.lit(None)
        elif isinstance(value, str):
            value = F.lit(value)
        out.append(value.cast(_FINDING_KINDS[name]).alias(name))
    return rows.select(*out)


@dataclass
class Tables:
    """What a scan reads. files: of sources.tree, with `text`; the others are optional."""

    files: DataFrame
    repos: DataFrame  # repo_id
    registry: DataFrame | None = None  # ecosystem, name, exists, created_at, weekly_downloads; observations also have fetched_at
    commits: DataFrame | None = None  # repo_id, body: of repositories scanned at their git root
    git_files: DataFrame | None = None  # repo_id, path, tracked, ignored
    now: Column = field(default_factory=F.current_timestamp)


@dataclass
class Found:
    """What a detector returns: findings, issues (ISSUE), and analysed files (repo_id, path)."""

    findings: DataFrame
    issues: DataFrame | None = None
    analysed: DataFrame | None = None
    skips: DataFrame | None = None  # repo_id, reason
    kept: list[DataFrame] = field(default_factory=list)  # persisted while the result is in use


def with_text(files: DataFrame) -> DataFrame:
    """files with their content as text; bytes that aren't UTF-8 become U+FFFD."""
    return files.withColumn("text", F.expr("make_valid_utf8(cast(content AS string))"))


def language(ext: Column) -> Column:
    return F.when(ext == ".py", "python").when(ext.isin(".tsx", ".jsx"), "tsx").when(ext == ".ts", "typescript").when(ext.isin(".js", ".mjs", ".cjs"), "javascript")
