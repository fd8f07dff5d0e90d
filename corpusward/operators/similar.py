"""Names within a small edit distance of known ones, by an equi-join on deletion variants.

Two strings within distance k share a string that arises from each by at most k deletions, and so
do their first n characters: an insertion on one side shifts at most one character of the other
beyond them. So the join is on such variants of bounded prefixes, and the built-in levenshtein, which
stops beyond its threshold, verifies the pairs. Names whose length no known name comes near are left
out before that. Nothing compares all names with all names, and a long name costs what a short one does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.names import distance_limit

#: The distance_limit of any name, and the characters of a name that variants are made of.
MOST, PREFIX = 2, 32


def _shorter(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def deletion_variants(s: Column, limit: Column) -> Column:
    """The first characters of a string, and what one or two deletions leave of them."""
    head = F.substring(s, 1, PREFIX)
    once = _shorter(head)
    twice = F.flatten(F.transform(once, _shorter))
    return F.array_distinct(F.concat(F.array(head), once, F.when(limit >= 2, twice).otherwise(F.array().cast("array<string>"))))


def similar_pairs(names: DataFrame, known: DataFrame, by: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, name, candidate, distance: distinct names with each known name (column `known`) of the same
    keys at a distance of at least 1 and at most the name's limit. Null names resemble nothing."""
    right = known.select(*keys, F.col("known").alias("candidate")).where("candidate is not null").distinct()
    size = F.length("candidate")
    near = right.select(*keys, F.explode(F.sequence(F.greatest(size - MOST, F.lit(0)), size + MOST)).alias("_size")).distinct()
    left = names.select(*keys, F.col(by).alias("name")).where("name is not null").distinct()
    left = left.withColumn("_size", F.length("name")).join(near, [*keys, "_size"], "left_semi")
    left = left.select(*keys, "name", F.explode(deletion_variants(F.col("name"), distance_limit(F.col("name")))).alias("variant"))
    right = right.select(*keys, "candidate", F.explode(deletion_variants(F.col("candidate"), F.lit(MOST))).alias("variant"))
    met = left.join(right, [*keys, "variant"]).select(*keys, "name", "candidate").distinct()
    distance = F.levenshtein("name", "candidate", MOST)  # -1 beyond it
    return met.withColumn("distance", distance).where((F.col("distance") >= 1) & (F.col("distance") <= distance_limit(F.col("name"))))


def nearest(names: DataFrame, known: DataFrame, by: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, name, candidate, distance: the nearest known name of the same keys (known, ord: its place in
    the list, which settles ties); names that are known themselves have none."""
    pairs = similar_pairs(names, known, by, keys).join(known.select(*keys, F.col("known").alias("candidate"), "ord"), [*keys, "candidate"])
    pairs = pairs.join(known.select(*keys, F.col("known").alias("name")), [*keys, "name"], "left_anti")
    best = F.min_by(F.struct("candidate", "distance"), F.struct("distance", "ord")).alias("x")
    return pairs.groupBy(*keys, "name").agg(best).select(*keys, "name", "x.candidate", "x.distance")
