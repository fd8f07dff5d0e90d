"""Severities, Trust Score, order of findings, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity and what a finding takes off the score, worst first. Fixed values.
WEIGHTS = {"critical": 25, "high": 12, "medium": 5, "low": 2, "info": 0}
#: Detectors in reporting order. Fixed values.
DETECTORS = ["ghost-deps", "secrets", "env-leak", "supply-chain", "dangerous-sinks", "insecure-crypto", "ai-unreviewed", "ai-presence"]
#: Lowest score, name, colour of a band. Fixed values.
BANDS = [(90, "excellent", "brightgreen"), (70, "good", "green"), (50, "fair", "yellow"), (30, "poor", "orange"), (0, "critical", "red")]


def _lookup(key: Column, values: dict, default) -> Column:
    return reduce(lambda when, kv: when.when(key == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, WEIGHTS, 0)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {s: i for i, s in enumerate(WEIGHTS)}, len(WEIGHTS))


def detector_rank(detector: Column) -> Column:
    return _lookup(detector, {d: i for i, d in enumerate(DETECTORS)}, 50)


def score_of(weight: Column) -> Column:
    """100 less a sum of weights, within 0 and 100; no findings score 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce(weight, F.lit(0)))).cast("long")


def trust_scores(repos: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key, trust_score for each of repos; findings (key, severity) of other keys don't count.

    Findings are summed before the join, so a repository with many adds one row to it."""
    sums = findings.groupBy(key).agg(F.sum(severity_weight(F.col("severity"))).alias("weight"))
    return repos.select(key).join(sums, key, "left").select(key, score_of(F.col("weight")).alias("trust_score"))


def severity_counts(repos: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key and a count for each of the five severities, zeros included."""
    counts = findings.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])
    return repos.select(key).join(counts, key, "left").fillna(0, list(WEIGHTS))


def band(score: Column) -> Column:
    return reduce(lambda when, b: when.when(score >= b[0], F.lit(b[1])), BANDS[1:], F.when(score >= BANDS[0][0], F.lit(BANDS[0][1]))).otherwise(F.lit(BANDS[-1][1]))


def finding_order(severity: Column, detector: Column, file: Column, line: Column) -> list[Column]:
    """Worst first, then by detector, file (in a locale's order) and line."""
    return [severity_rank(severity), detector_rank(detector), F.collate(F.coalesce(file, F.lit("")), "UNICODE"), F.coalesce(line, F.lit(0))]


def gate(counts: DataFrame, minimum: int | Column = 85, fail_on: tuple[str, ...] | Column = (), fail_on_incomplete: bool | Column = False) -> DataFrame:
    """counts (trust_score, a count for each severity, issues) with reasons, passed and status. The
    limits are the same for all rows, or columns (fail_on: an array)."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    s, least = F.col("trust_score"), as_column(minimum)
    severities = fail_on if isinstance(fail_on, Column) else F.array(*map(F.lit, fail_on)).cast("array<string>")
    by_name = F.create_map(*[x for name in WEIGHTS for x in (F.lit(name), F.col(name))])
    score = F.when(s < least, F.concat(F.lit("Trust Score "), s.cast("string"), F.lit("/100 is below the "), least.cast("string"), F.lit("/100 threshold")))

    def named(x: Column) -> Column:
        n = F.try_element_at(by_name, x)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), x, F.lit("-severity "), F.when(n == 1, "finding").otherwise("findings")))

    n = F.col("issues")
    missed = F.when(as_column(fail_on_incomplete) & (n > 0), F.concat(F.lit("Scan incomplete: "), n.cast("string"), F.when(n == 1, " input could").otherwise(" inputs could"), F.lit(" not be analyzed")))
    reasons = F.array_compact(F.concat(F.array(score), F.transform(severities, named), F.array(missed)))
    blocked = (F.col("critical") > 0) | (F.size("reasons") > 0)
    status = F.when(blocked, "BLOCKED").when((F.col("high") > 0) | (F.col("medium") > 0), "REVIEW").otherwise("READY")
    return counts.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0).withColumn("status", status)
