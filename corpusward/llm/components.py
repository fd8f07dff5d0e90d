"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.shared import cut, left_join_spread


def _star(links: DataFrame) -> DataFrame:
    """a, least (of its b) and n (how many it has)."""
    return links.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """links (a, b) with the least b of their a. A node of many links is dealt to many tasks."""
    star = _star(links)
    return left_join_spread(links, star.select("a", "least"), "a", star.select("a", "n"), total)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours move to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = _with_least(both, 2 * total).where("b > a")
    return moved.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Each node (a) and its smaller neighbours (b) move to the least of these."""
    moved = _with_least(links, total)
    ends = F.array(F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.select(F.explode(ends).alias("x")).select("x.*").where("a > b").distinct()


def connected(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root for each node of links (a, b): root is the least node that it is connected to.

    Each round's links are kept in the shared folder, so that lineage stays short; the rounds
    needed grow with the logarithm of the longest path."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(links)
    for _ in range(most_rounds if before[0] else 0):
        links = cut(_small_star(cut(_large_star(links, before[0])), before[0]))
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
