"""A scan of one or many repositories: detectors, diagnostics, scores, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward import policy as policies
from corpusward.detectors import ai_presence, ai_unreviewed, crypto, env_leak, ghost_deps, secrets, sinks, supply_chain
from corpusward.operators import scope, scoring
from corpusward.policy import Policy
from corpusward.schemas import ISSUE, Found, Tables, with_text
from corpusward.sources import git
from corpusward.sources.tree import read_trees

Detector = Callable[[Tables], Found]
#: Detectors in their default order; pass others to scan() to extend or replace them.
DETECTORS: dict[str, Detector] = {m.ID: m.detect for m in (ghost_deps, secrets, ai_unreviewed, sinks, supply_chain, env_leak, crypto, ai_presence)}


def select(only: Iterable[str] | None = None, skip: Iterable[str] | None = None, known: dict[str, Detector] | None = None) -> dict[str, Detector]:
    """Detectors by id; those left out never get into the plan."""
    known = DETECTORS if known is None else known
    only, skip = list(only or []), list(skip or [])
    if unknown := [x for x in only + skip if x not in known]:
        raise ValueError(f"Unknown detectors: {', '.join(unknown)}. Known: {', '.join(known)}.")
    chosen = {k: v for k, v in known.items() if (not only or k in only) and k not in skip}
    if not chosen:
        raise ValueError("No detectors are left to run.")
    return chosen


@dataclass
class Result:
    """repos: repo_id. findings, issues: see schemas. stats: repo_id, detector_id, status, findings, analysed."""

    repos: DataFrame
    findings: DataFrame
    issues: DataFrame
    stats: DataFrame
    kept: tuple[DataFrame, ...] = ()  # persisted while the result is in use

    def release(self) -> None:
        """Frees what the result keeps, when nothing reads it any more."""
        for some in self.kept:
            some.unpersist()

    def sorted_findings(self) -> DataFrame:
        order = scoring.finding_order(F.col("severity"), F.col("detector_id"), F.col("file"), F.col("line"))
        return self.findings.orderBy("repo_id", *order, "id")

    def summary(self) -> DataFrame:
        """repo_id, trust_score, band, the five counts, issues."""
        scores = scoring.trust_scores(self.repos, self.findings, "repo_id")
        counts = scoring.severity_counts(self.repos, self.findings, "repo_id")
        issues = self.issues.groupBy("repo_id").agg(F.count("*").alias("issues"))
        return scores.join(counts, "repo_id").join(issues, "repo_id", "left").fillna(0, ["issues"]).withColumn("band", scoring.band(F.col("trust_score")))

    def gated(self, policy: Policy | dict[str, Policy], fallback: int = 85) -> DataFrame:
        """summary with reasons, passed and status, by one policy or by one for each repository."""
        summary = self.summary()
        if isinstance(policy, Policy):
            minimum = policy.minimum_score if policy.minimum_score is not None else fallback
            return scoring.gate(summary, minimum, policy.fail_on, policy.fail_on_incomplete)
        own = summary.join(policies.table(self.repos.sparkSession, policy, fallback).select("repo_id", "minimum_score", "fail_on", "fail_on_incomplete"), "repo_id", "left")
        made = scoring.gate(own, F.coalesce("minimum_score", F.lit(fallback)), F.coalesce("fail_on", F.array().cast("array<string>")), F.coalesce("fail_on_incomplete", F.lit(False)))
        return made.drop("minimum_score", "fail_on", "fail_on_incomplete")


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n: how many rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Issues, each once."""
    return issues.dropDuplicates(["repo_id", "detector_id", "code", "message", "file"])


def incomplete(issues: DataFrame, *keys: str) -> DataFrame:
    """keys, issues, files (how many have one), incomplete: of distinct issues."""
    return distinct_issues(issues).groupBy(*keys).agg(F.count("*").alias("issues"), F.countDistinct("file").alias("files"), (F.count("*") > 0).alias("incomplete"))


def _stats(repos: DataFrame, found: dict[str, Found], findings: DataFrame, issues: DataFrame) -> DataFrame:
    spark = repos.sparkSession
    every = repos.select("repo_id", F.explode(F.array(*map(F.lit, found))).alias("detector_id"))
    none = spark.createDataFrame([], "repo_id string, detector_id string, n long")
    key = ["repo_id", "detector_id"]
    analysed = reduce(lambda a, b: a.unionByName(b), [none] + [counted(f.analysed.withColumn("detector_id", F.lit(d)), *key) for d, f in found.items() if f.analysed is not None])
    skipped = reduce(lambda a, b: a.unionByName(b), [none.select("repo_id", "detector_id")] + [f.skips.select("repo_id", F.lit(d).alias("detector_id")) for d, f in found.items() if f.skips is not None]).withColumn("skipped", F.lit(True))
    rows = every.join(counted(findings, *key).withColumnRenamed("n", "findings"), key, "left").join(counted(issues, *key).withColumnRenamed("n", "issues"), key, "left").join(analysed.withColumnRenamed("n", "analysed"), key, "left").join(skipped, key, "left")
    rows = rows.fillna(0, ["findings", "issues", "analysed"])
    status = F.when(F.col("skipped"), "skipped").when(F.col("issues") > 0, "degraded").otherwise("ran")
    return rows.select(*key, status.alias("status"), "findings", "issues", "analysed")


def scan(tables: Tables, detectors: dict[str, Detector] | None = None) -> Result:
    """All detectors over all repositories, as one lazy plan over one table of files."""
    found = {name: detect(tables) for name, detect in (DETECTORS if detectors is None else detectors).items()}
    spark = tables.files.sparkSession
    findings = reduce(lambda a, b: a.unionByName(b), [f.findings for f in found.values()])
    walk = tables.files.where("issue_code is not null")
    readers = {"text": ["secrets", "env-leak", "dangerous-sinks", "insecure-crypto", "ai-presence"], "package": ["ghost-deps"]}
    issues = [f.issues for f in found.values() if f.issues is not None]
    for kind, names in readers.items():
        if some := [n for n in names if n in found]:
            issues.append(walk.where(f"in_{kind}_walk").select("repo_id", F.explode(F.array(*map(F.lit, some))).alias("detector_id"), F.col("issue_code").alias("code"), F.col("issue_message").alias("message"), F.col("path").alias("file")))
    issues = distinct_issues(reduce(lambda a, b: a.unionByName(b), issues, spark.createDataFrame([], ISSUE)))
    return Result(tables.repos, findings, issues, _stats(tables.repos, found, findings, issues), tuple(k for f in found.values() for k in f.kept))


def scan_folders(spark: SparkSession, folders: dict[str, str], detectors: dict[str, Detector] | None = None, registry: DataFrame | None = None, commits: DataFrame | None = None, git_files: DataFrame | None = None, now: Column | None = None) -> Result:
    """A scan of repositories by id and folder; the folders are ones that all executors see. What git
    knows of their environment files is asked here, where it isn't given."""
    files = with_text(read_trees(spark, folders)).persist(StorageLevel.DISK_ONLY)  # each detector reads them; none is held in memory
    if git_files is None and (detectors is None or env_leak.ID in detectors):
        git_files = git.env_files(spark, folders, env_leak.env_paths(files))
    repos = spark.createDataFrame([(r,) for r in folders], "repo_id string")
    tables = Tables(files, repos, registry, commits, git_files)
    if now is not None:
        tables.now = now
    made = scan(tables, detectors)
    return replace(made, kept=(*made.kept, files))


def with_policy(result: Result, policy: Policy | dict[str, Policy]) -> Result:
    """The result without what the policy (or that of each repository) ignores; statuses and scores
    follow from what is left."""
    if isinstance(policy, Policy):
        found = scope.without_ignored(result.findings, policy.ignore_detectors, policy.ignore_findings, policy.ignore_paths)
        return _restated(result, found, scope.without_ignored(result.issues, policy.ignore_detectors, (), policy.ignore_paths))
    own = policies.table(result.repos.sparkSession, policy)
    return _restated(result, scope.without_ignored_by(result.findings, own), scope.without_ignored_by(result.issues, own, by_id=False))


def changed_only(result: Result, changed: DataFrame) -> Result:
    """The result for changed files (repo_id, path); comes before the policy."""
    return _restated(result, scope.in_changed(result.findings, changed), scope.issues_in_changed(result.issues, changed))


def _restated(result: Result, findings: DataFrame, issues: DataFrame) -> Result:
    key = ["repo_id", "detector_id"]
    n = findings.groupBy(*key).agg(F.count("*").alias("findings"))
    m = issues.groupBy(*key).agg(F.count("*").alias("issues"))
    stats = result.stats.select(*key, "status", "analysed").join(n, key, "left").join(m, key, "left").fillna(0, ["findings", "issues"])
    status = F.when((F.col("status") == "degraded") & (F.col("issues") == 0), "ran").otherwise(F.col("status"))
    return Result(result.repos, findings, issues, stats.withColumn("status", status), result.kept)
