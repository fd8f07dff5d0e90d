"""What of the findings and issues is in scope: changed files, ignore lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.text import in_globs, normalized_path


def _repo(rows: DataFrame, changed: DataFrame) -> list[str]:
    """repo_id, where both tables have it: a path only means a file of its own repository."""
    return ["repo_id"] if "repo_id" in rows.columns and "repo_id" in changed.columns else []


def in_changed(findings: DataFrame, changed: DataFrame, file: str = "file", by: str = "path") -> DataFrame:
    """Findings in changed files of their repository; findings without a file go."""
    key = _repo(findings, changed)
    paths = changed.select(*key, normalized_path(F.col(by)).alias("_path")).distinct()
    return findings.withColumn("_path", normalized_path(findings[file])).join(paths, [*key, "_path"], "left_semi").select(*findings.columns)


def issues_in_changed(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues without a file, at the root, or whose file is a changed file or a folder that holds one.

    A changed path stands for itself and each of its folders, so this is an equi-join."""
    key = _repo(issues, changed)
    parts = F.split(normalized_path(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    reached = changed.select(*key, F.explode(above).alias("_path")).distinct()
    path = F.regexp_replace(normalized_path(F.col("file")), "/$", "")
    everywhere = F.col("file").isNull() | F.col("file").isin("", ".")
    rest = issues.where(~everywhere).withColumn("_path", path).join(reached, [*key, "_path"], "left_semi").select(*issues.columns)
    return issues.where(everywhere).unionByName(rest)


def without_ignored(findings: DataFrame, detectors: list[str] = (), ids: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """Findings that no ignore list names; one without a file is never ignored by path."""
    kept = findings
    if detectors:
        kept = kept.where(~F.col("detector_id").isin(list(detectors)))
    if ids:
        kept = kept.where(~F.col("id").isin(list(ids)))
    if globs:
        kept = kept.where(~in_globs(F.col("file"), list(globs)))
    return kept


def without_ignored_by(rows: DataFrame, policies: DataFrame, by_id: bool = True) -> DataFrame:
    """Findings (or issues, which have no ids) that the policy of their repository doesn't ignore.
    policies: of policy.table; a repository without one ignores nothing. One join, however many
    policies there are and whatever they list."""
    named = policies.select("repo_id", "ignore_detectors", "ignore_findings", "ignore_paths")
    path = normalized_path(F.col("file"))
    ignored = [F.array_contains("ignore_detectors", F.col("detector_id")), (path != "") & F.rlike(path, F.col("ignore_paths"))]
    if by_id:
        ignored.append(F.array_contains("ignore_findings", F.col("id")))
    held = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in ignored])
    return rows.join(named, "repo_id", "left").where(~held).select(*rows.columns)
