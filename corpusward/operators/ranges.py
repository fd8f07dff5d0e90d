"""Inclusive line ranges: merge, subtraction, counts, text.

Both sweep along the starts and ends of a key's ranges. A key with many of them is cut into parts of
about equal numbers, which are swept apart: islands are found within a part, and what the parts
before it leave (the furthest end, the ranges that are open, the island that goes on) comes to it in
one row. Nothing is as large as a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task sweeps; parts of a key at most; hot keys that are broadcast at most.
ROWS, PARTS, HOT_KEYS = 1 << 20, 1000, 1000


def _met(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """rows with table's columns; nulls meet nulls."""
    named = table.select(*[F.col(c).alias(f"_{c}_" if c in on else c) for c in table.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in on])
    return rows.join(F.broadcast(named) if small else named, same, how).drop(*[f"_{c}_" for c in on])


def _hot(ranges: DataFrame, keys: list[str], each: int = 1) -> tuple[DataFrame, int, int] | None:
    """(the keys of more than ROWS rows, how many they are, parts of each), or None. each: what a range counts."""
    counts = ranges.groupBy(*keys).agg((each * F.count("*")).alias("_n")).where(F.col("_n") > ROWS)
    n_hot, most = counts.agg(F.count("*"), F.max("_n")).first()
    return (counts.select(*keys), n_hot, min(PARTS, -(-most // ROWS))) if n_hot else None


def _parted(rows: DataFrame, keys: list[str], by: str, hot: tuple[DataFrame, int, int]) -> DataFrame:
    """rows with `_part`: those of hot keys in parts of about equal numbers, in the order of `by`. Each key
    has a value of `by` once."""
    of_hot, n_hot, parts = hot
    some = _met(rows, of_hot, keys, "left_semi", n_hot <= HOT_KEYS)
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = some.groupBy(*keys).agg(F.percentile_approx(by, shares, 10_000).alias("_cuts"))
    dealt = _met(rows, cuts, keys, small=n_hot <= HOT_KEYS)
    return dealt.withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(by))), F.lit(0))).drop("_cuts")


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of the islands of each key, in one sweep."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, "start", "end").withColumn("_new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge(ranges: DataFrame, *keys: str, spread: bool = True) -> DataFrame:
    """keys, start, end: overlapping and adjacent ranges of a key become one.

    spread: first count the ranges of each key, to find those to cut into parts; without it nothing
    runs before the result is asked for, and a key is swept in one task."""
    keys = list(keys)
    hot = _hot(ranges, keys) if spread else None
    return _islands(ranges, keys) if hot is None else _stitched(ranges, keys, hot)


def _stitched(ranges: DataFrame, keys: list[str], hot: tuple[DataFrame, int, int]) -> DataFrame:
    """What merge gives, with hot keys in parts."""
    rows = _parted(ranges.groupBy(*keys, "start").agg(F.max("end").alias("end")), keys, "start", hot)
    of_part = [*keys, "_part"]
    local = _islands(rows, of_part)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = local.groupBy(*of_part).agg(F.max("end").alias("_top")).select(*of_part, F.max("_top").over(earlier).alias("_reach"))
    local = _met(local, reach, of_part).withColumn("_more", F.coalesce(F.col("start") <= F.col("_reach") + 1, F.lit(False)))
    last = local.groupBy(*of_part).agg(F.max(F.when(~F.col("_more"), F.col("start"))).alias("_last")).select(*of_part, F.max("_last").over(earlier).alias("_begun"))
    named = _met(local, last, of_part).withColumn("start", F.when(F.col("_more"), F.col("_begun")).otherwise(F.col("start")))
    return named.groupBy(*keys, "start").agg(F.max("end").alias("end"))


def subtract(base: DataFrame, cut: DataFrame, *keys: str, spread: bool = True) -> DataFrame:
    """keys, start, end: what of base no range of cut covers, merged.

    A sweep over the ends of ranges, so the work doesn't depend on how long they are. spread: as for merge."""
    keys = list(keys)

    def ends(ranges: DataFrame, is_base: bool) -> DataFrame:
        opened = [F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d"))]
        some = ranges.select(*keys, F.explode(F.array(*opened)).alias("x"))
        return some.select(*keys, "x.at", F.when(F.lit(is_base), F.col("x.d")).otherwise(0).alias("b"), F.when(F.lit(is_base), 0).otherwise(F.col("x.d")).alias("c"))

    points = ends(base, True).unionByName(ends(cut, False)).groupBy(*keys, "at").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    hot = _hot(base.select(*keys).unionByName(cut.select(*keys)), keys, 2) if spread else None
    rows = None if hot is None else _parted(points, keys, "at", hot)
    of_part = keys if rows is None else [*keys, "_part"]
    order = Window.partitionBy(*of_part).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = (points if rows is None else rows).select(*of_part, F.col("at").alias("start"), F.lead("at").over(order).alias("_next"), F.sum("b").over(so_far).alias("b"), F.sum("c").over(so_far).alias("c"))
    if rows is not None:
        sums = rows.groupBy(*of_part).agg(F.min("at").alias("_at"), F.sum("b").alias("_b"), F.sum("c").alias("_c"))
        parts = Window.partitionBy(*keys).orderBy("_part")
        earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*of_part, F.lead("_at").over(parts).alias("_after"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_open") for x in ("_b", "_c")])
        swept = _met(swept, before, of_part).select(*keys, "start", F.coalesce("_next", "_after").alias("_next"), (F.col("b") + F.col("_b_open")).alias("b"), (F.col("c") + F.col("_c_open")).alias("c"))
    swept = swept.withColumn("end", F.col("_next") - 1)
    left = swept.where("b > 0 and c = 0 and end is not null").select(*keys, "start", "end")
    return _islands(left, keys) if hot is None else _stitched(left, keys, hot)


def line_count(start: Column, end: Column) -> Column:
    return F.sum(end - start + 1)


def formatted(ranges: Column) -> Column:
    """An array of (start, end) structs as text: 1–4, 7."""
    one = lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat(r["start"].cast("string"), F.lit("–"), r["end"].cast("string")))
    return F.array_join(F.transform(ranges, one), ", ")
