"""All matches of patterns, with the line each begins on.

The JVM tells which texts can match, and only these go to Python, in Arrow batches and once for all
patterns. A text's line breaks are found once and each match's line by bisection in them, so the
work is that of the text and its matches. Patterns mean what they mean in the JVM: \\w, \\d, \\s and (?i) are
those of ASCII, and a dot is no line end; but \\b is that of ASCII too."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND = "array<struct<rule:string,match:string,line:int,near:boolean>>"
_TYPE = pa.list_(pa.struct([("rule", pa.string()), ("match", pa.string()), ("line", pa.int32()), ("near", pa.bool_())]))
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\.", re.S)


def compiled(pattern: str) -> re.Pattern:
    """A JVM pattern for this language: only dots differ."""
    return re.compile(_TOKEN.sub(lambda m: "[^\\n\\r\\x85\\u2028\\u2029]" if m.group() == "." else m.group(), pattern), re.ASCII)


def found_in(text: str, patterns: dict[str, re.Pattern], near: re.Pattern | None = None) -> Iterator[tuple[str, str, int, bool | None]]:
    """(rule, match, line, near) of each match. near: does a word stand on the match's lines, or on the one before?"""
    breaks = [m.start() for m in re.finditer("\n", text)]
    held: dict[int, bool] = {}

    def has_word(line: int) -> bool:
        if line not in held:
            held[line] = bool(near.search(text, breaks[line - 1] + 1 if line else 0, breaks[line] if line < len(breaks) else len(text)))
        return held[line]

    for rule, pattern in patterns.items():
        for m in pattern.finditer(text):
            low = bisect_right(breaks, m.start() - 1)
            beside = None
            if near is not None:
                high = bisect_right(breaks, m.end() - 1, low)
                beside = any(map(has_word, range(max(0, low - 1), high + 1)))
            yield rule, m.group(), low + 1, beside


def matches(text: Column, patterns: dict[str, str], near: str | None = None) -> Column:
    """array<struct<rule, match, line, near>> of each pattern's matches, by rule. Patterns never match nothing."""
    own, word = {r: compiled(p) for r, p in patterns.items()}, near and compiled(near)

    @F.arrow_udf(_FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            rows, ends = [], [0]
            for text in some.to_pylist():
                if text:
                    rows.extend(found_in(text, own, word))
                ends.append(len(rows))
            columns = list(zip(*rows)) or [[]] * 4
            parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPE.value_type)], fields=list(_TYPE.value_type))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    return find(text)


def may_match(text: Column, patterns: dict[str, str]) -> Column:
    """False only of texts in which no pattern matches."""
    return reduce(lambda a, b: a | b, [text.rlike(p.replace(r"\b", "")) for p in patterns.values()])


def scan_all(files: DataFrame, patterns: dict[str, str], text: str = "text", near: str | None = None) -> DataFrame:
    """files with rule, match, line and (where `near` is given) near, a row for each match of each
    pattern (by rule), in one pass. Texts are null, empty or of any length."""
    some = files.where(may_match(F.col(text), patterns))
    named = ["rule", "match", "line"] + ([] if near is None else ["near"])
    return some.withColumn("_m", F.explode(matches(F.col(text), patterns, near))).select("*", *[f"_m.{c}" for c in named]).drop("_m")


def scan(files: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """files with match and line, one row for each match."""
    return scan_all(files, {"": pattern}, text).drop("rule")
