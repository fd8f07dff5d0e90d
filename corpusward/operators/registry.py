"""What a registry said of packages, and when: the latest answer before a scan, if it is fresh enough.

Observations are a table (keys, fetched_at, exists, and more). Each holds from when it was fetched
until the next one of its key or until it expires. Time is cut into buckets as long as an answer
lives, so an observation holds in two buckets at most; references meet the observations of their
key and bucket in an equi-join, and no window orders the references of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.operators.references import first_by

#: How long an answer counts. Fixed value.
TTL_HOURS = 24
_HOUR = 3_600_000_000


def micros(at: Column, kind: str) -> Column:
    """Microseconds, of timestamps with or without a time zone (then taken as UTC)."""
    return F.unix_micros(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()) if kind == "timestamp_ntz" else at)


def observed(observations: DataFrame, keys: list[str], ttl_hours: float = TTL_HOURS) -> DataFrame:
    """observations with `_from` and `_until` (microseconds, both included). Lookups that failed (exists
    is null) or have no time are no observations; of those of one key and time the first by its columns counts."""
    told = observations.where("exists is not null and fetched_at is not null")
    start = micros(F.col("fetched_at"), dict(observations.dtypes)["fetched_at"])
    rest = [F.col(c) for c in observations.columns if c not in (*keys, "fetched_at")]
    once = first_by(told, [*keys, "fetched_at"], rest).withColumn("_from", start)
    following = F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from")) - 1
    expires = F.col("_from") + F.lit(round(ttl_hours * _HOUR))
    return once.withColumn("_until", F.least(expires, F.coalesce(following, expires)))


def as_of(refs: DataFrame, observations: DataFrame, keys: list[str], at: str, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """refs (keys, and a time in the column `at`) with the other columns of the observation that held
    then; nulls where there was none, or only an expired one: unknown, not missing. Null keys and
    times meet nothing; repeated refs come out repeated."""
    length = max(1, round(ttl_hours * _HOUR))
    held = observed(observations, keys, ttl_hours)
    bucket = lambda c: F.floor(c / F.lit(length)).cast("long")
    spread = held.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_until")))))
    spread = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in spread.columns if c not in keys])
    asked = refs.withColumn("_at", micros(F.col(at), dict(refs.dtypes)[at])).withColumn("_in", bucket(F.col("_at")))
    fits = (F.col("_in") == F.col("_bucket")) & F.col("_at").between(F.col("_from"), F.col("_until"))
    for k in keys:
        fits &= F.col(k) == F.col(f"_{k}")
    return asked.join(spread, fits, "left").drop("_at", "_in", "_from", "_until", "_bucket", *[f"_{k}" for k in keys])


def earliest_release(releases: DataFrame, *keys: str) -> DataFrame:
    """keys, created_at: when the first file of any release of a package was published. Files without a time don't count."""
    return releases.where("released_at is not null").groupBy(*keys).agg(F.min("released_at").alias("created_at"))
