"""Quality rules as learned decision lists, in DataFrame functions only.

Statistics of each text are one native expression. Sequential covering learns from the labelled
texts' statistics: a rule grows by the threshold condition of the highest information gain on one
part of the labelled rows, is pruned from its end on the other part, and is kept if it is precise
there; the rows it covers leave, and the next rule grows. Each step is one aggregation over all
labelled rows left, of which the driver gets counts by statistic and threshold interval. The list
becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.shared import cut

_SPACE = "[\\x20\\x09-\\x0D]+"
_SPACE_SIGNS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counted(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that stand twice or more in the text."""

    def covered(slots: Column) -> Column:  # slots: (window, place), sorted
        twice = F.filter(slots, lambda x, i: (F.get(slots, i - 1)["h"] == x["h"]) | (F.get(slots, i + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n")))["n"]

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")))

    slots = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(F.sort_array(windows(hashes)), covered))
    return F.when(F.size(words) < 3, 0).otherwise(F.coalesce(slots, F.lit(0)))


def statistics(text: Column) -> Column:
    """A struct of counts of the whole text; a null text counts as an empty one. Windows are told
    apart by 64-bit hashes within one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE_SIGNS, "")) > 0)
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return _let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            F.length(F.translate(text, _SPACE_SIGNS, "")).cast("long").alias("word_chars"),
            _counted(text, SYMBOLS).cast("long").alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            s["l"]["n_lines"].alias("n_lines"),
            s["w"]["n_distinct"].alias("n_distinct"),
            _counted(text, _CAPITALS).cast("long").alias("n_capitals"),
            _counted(text, "!?").cast("long").alias("n_marks"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


#: What rules may test, from the counts.
FEATURES = {
    "words": lambda s: s["n_words"].cast("double"),
    "word length": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbols a word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "repeated lines": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeated words": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "distinct words": lambda s: s["n_distinct"] / F.greatest(s["n_words"], F.lit(1)),
    "capitals": lambda s: s["n_capitals"] / F.greatest(s["word_chars"], F.lit(1)),
    "marks a word": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, s: Column) -> Column:
        value = FEATURES[self.feature](s)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Texts for which all conditions hold are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, s: Column) -> Column:
        held = F.lit(True)
        for c in self.conditions:
            held = held & c.holds(s)
        return held


def verdict(rules: list[Rule], s: Column) -> Column:
    """Is a text kept? The base rules come first, then the learned list in its order."""
    out = F.when(base_failed(s), False)
    for rule in rules:
        out = out.when(rule.holds(s), False)
    return out.otherwise(True)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, intervals: int = 24, most_rules: int = 6, most_conditions: int = 3, least_precision: float = 0.9, least_rows: int = 5) -> list[Rule]:
    """Rules for rejection from labelled (s: the statistics; bad: boolean; part: 0 and 1 to grow on,
    2 to prune on). Rows that the base rules fail don't count.

    Thresholds lie halfway between quantiles of all labelled rows and of the bad ones, `intervals` of each."""
    rows = labelled.where("bad is not null").where(~base_failed(F.col("s"))).select(*[f(F.col("s")).alias(f"f{i}") for i, f in enumerate(FEATURES.values())], "bad", "part")
    rows = cut(rows)
    shares = [i / intervals for i in range(1, intervals)]
    quantiles = lambda i: F.percentile_approx(f"f{i}", shares, 10_000)
    bad = lambda i: F.percentile_approx(F.when(F.col("bad"), F.col(f"f{i}")), shares, 10_000)
    found = rows.agg(*[x for i in range(len(FEATURES)) for x in (quantiles(i), bad(i))]).first()
    values = [sorted({*(found[2 * i] or []), *(found[2 * i + 1] or [])}) for i in range(len(FEATURES))]
    steps = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in values]
    names = list(FEATURES)

    def test(c: Condition) -> Column:
        value = F.col(f"f{names.index(c.feature)}")
        return value > c.threshold if c.above else value <= c.threshold

    def together(conditions) -> Column:
        held = F.lit(True)
        for c in conditions:
            held = held & test(c)
        return held

    def tallies(left: DataFrame) -> dict[tuple[int, int], list[int]]:
        """(bad, good) rows by feature and number of thresholds below the value."""
        below = lambda i: F.size(F.filter(F.lit(steps[i]).cast("array<double>"), lambda t: t < F.col(f"f{i}")))
        cells = F.array(*[F.struct(F.lit(i).alias("f"), below(i).alias("k")) for i in range(len(FEATURES)) if steps[i]])
        counted = left.select(F.explode(cells).alias("c"), "bad").groupBy("c.f", "c.k").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        return {(r.f, r.k): [r.p, r.n] for r in counted.collect()}

    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules and any(steps):
        conditions: list[Condition] = []
        while len(conditions) < most_conditions:
            cells = tallies(left.where("part < 2").where(together(conditions)))
            some = next((i for i in range(len(steps)) if steps[i]), 0)
            p0, n0 = (sum(v[j] for (f, _), v in cells.items() if f == some) for j in (0, 1))
            if not p0 or not n0:
                break
            best, choice = 1e-9, None
            for f, thresholds in enumerate(steps):
                p = n = 0
                for k, threshold in enumerate(thresholds):
                    p, n = (x + y for x, y in zip((p, n), cells.get((f, k), (0, 0))))
                    for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                        if a >= least_rows and (gain := _gain(a, b, p0, n0)) > best:
                            best, choice = gain, Condition(names[f], above, threshold)
            if choice is None:
                break
            conditions.append(choice)
        if not conditions:
            break
        prune = left.where("part = 2")
        cover = [together(conditions[: k + 1]) for k in range(len(conditions))]
        counts = prune.agg(*[F.count_if(c & b) for c in cover for b in (F.col("bad"), ~F.col("bad"))]).first()
        worth = [((counts[2 * k] - counts[2 * k + 1]) / max(1, counts[2 * k] + counts[2 * k + 1]), -k) for k in range(len(conditions))]
        keep = 1 - max(worth)[1]
        p, n = counts[2 * keep - 2], counts[2 * keep - 1]
        if p + n < least_rows or p < least_precision * (p + n):
            break
        rules.append(Rule(tuple(conditions[:keep])))
        left = left.where(~together(conditions[:keep]))
    return rules


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("of"), (F.col("quality") == 0).alias("bad"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part")
    return stats.join(marks, stats.doc_id == marks.of).select("s", "bad", part)


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, s (the counts), base_failed and kept of every row of docs, by rules learned from
    labels (doc_id, quality: 0 or 1).

    A null or empty text has no words and fails the base rules. Rows without a doc_id are judged but
    not learned from; a doc_id that is repeated, in docs or labels, counts as often. Without usable
    labels the base rules stand alone. No rows give no rows; other columns play no part."""
    stats = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(docs["text"]).alias("s")))
    rules = learn(_labelled(stats, labels), **how)
    return stats.select("doc_id", "s", base_failed(F.col("s")).alias("base_failed"), verdict(rules, F.col("s")).alias("kept"))


def good_rows(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that the rules keep. Nulls, repeats and no rows: as for judged.

    The rows are kept with their statistics in the shared folder, as these cost far more than a copy
    of the texts and both the learning and the verdict need them."""
    rows = cut(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), statistics(docs["text"]).alias("s")))
    rules = learn(_labelled(rows.select("doc_id", "s"), labels), **how)
    return rows.where(verdict(rules, F.col("s"))).select("doc.*")
