"""Package references: dedupe by source, resolution, registry lookup, decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.names import matches_pattern

#: How far a source of a reference is trusted. Fixed values.
SOURCE_RANK = {"manifest": 3, "docs": 2, "import": 1}
MIN_AGE_DAYS, MIN_DOWNLOADS, MATURE_DAYS = 14, 100, 180


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key for which `order` is least, nulls first. Keys are reduced before they are
    shuffled, so one with many rows doesn't fill a task."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def source_rank(source: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in SOURCE_RANK.items():
        out = out.when(source == name, rank)
    return out.otherwise(0)


def aliased(refs: DataFrame, patterns: DataFrame, *keys: str) -> DataFrame:
    """refs (keys, specifier) with each pattern of their key that fits: an equi-join on what stands
    before the pattern's *, of which a specifier has one for each of its lengths among the patterns."""
    star = F.instr("pattern", "*")
    known = patterns.withColumn("_head", F.when(star > 0, F.substring("pattern", F.lit(1), star - 1)).otherwise(F.col("pattern")))
    lengths = known.groupBy(*keys).agg(F.collect_set(F.length("_head")).alias("_lengths"))
    sized = refs.join(lengths, list(keys)) if keys else refs.join(F.broadcast(lengths))
    heads = sized.withColumn("_length", F.explode("_lengths")).where(F.length("specifier") >= F.col("_length"))
    heads = heads.withColumn("_head", F.substring("specifier", F.lit(1), F.col("_length"))).drop("_lengths", "_length")
    met = heads.join(known, [*keys, "_head"]).where(matches_pattern(F.col("pattern"), F.col("specifier")))
    return met.drop("_head")


def with_registry(refs: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """refs with the registry's columns. No row there leaves `exists` null: unknown, not missing."""
    return refs.join(registry, keys, "left")


def decisions(exists: Column, blind: Column, typo: Column, age_days: Column, downloads: Column, is_npm: Column, min_age_days: float = MIN_AGE_DAYS, min_downloads: int = MIN_DOWNLOADS, mature_days: float = MATURE_DAYS) -> Column:
    """array<struct<kind, severity>> of what a looked-up reference is flagged for.

    exists: null is unknown. A missing age or number of downloads fails its comparison."""
    flag = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    young = F.coalesce(age_days < mature_days, F.lit(False))
    rare = F.coalesce(downloads < min_downloads, F.lit(False))
    very_new = F.coalesce(age_days < min_age_days, F.lit(False))
    none = F.array().cast("array<struct<kind:string,severity:string>>")
    known = F.when(typo & (young | rare), F.array(flag("typosquat", "critical"))).otherwise(
        F.array_compact(F.array(F.when(very_new, flag("very-new", "medium")), F.when(is_npm & rare & young, flag("low-downloads", "low"))))
    )
    return (
        F.when(exists.isNull(), F.when(blind, F.array(flag("ambiguous-blind", "high"))).otherwise(none))
        .when(~exists & typo, F.array(flag("nonexistent-typosquat", "critical")))
        .when(~exists & blind, F.array(flag("nonexistent-blind", "high")))
        .when(~exists, F.array(flag("nonexistent", "critical")))
        .otherwise(known)
    )
