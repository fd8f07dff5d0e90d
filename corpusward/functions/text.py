"""Text helpers as column expressions: entropy, masks, globs, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand in for a secret. Fixed value.
PLACEHOLDER = r"(?i)^(?:your[_-]?|my[_-]?|xxx+|placeholder|changeme|example|sample|dummy|test|todo|fixme|insert|replace|<.*>|\$\{.*\}|process\.env)"


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def shannon_entropy(value: Column) -> Column:
    """Bits a character over the characters that occur; 0 for an empty value."""
    runs = F.transform(
        F.array_distinct(characters(value)),
        lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double") / F.length(value),
    )
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(-F.aggregate(runs, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def is_placeholder(value: Column, pattern: str | None = PLACEHOLDER) -> Column:
    """pattern: of values that stand in for a secret; None if only few different characters tell."""
    few = F.size(F.array_distinct(characters(value))) < 6
    return few if pattern is None else value.rlike(pattern) | few


def masked(value: Column) -> Column:
    """Never the whole secret."""
    return F.when(F.length(value) <= 8, F.lit("****")).otherwise(F.concat(F.substring(value, 1, 4), F.lit("…"), F.right(value, F.lit(4))))


def snippet(value: Column, most: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob over normalised paths: ** crosses folders, * and ? don't."""
    glob = re.sub(r"^\./", "", glob.replace("\\", "/"))
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return r"\A" + "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*|.", glob, re.S)) + r"\z"


def in_globs(path: Column, globs: list[str]) -> Column:
    """Does any glob fit? A missing path is never in one."""
    path = normalized_path(path)
    held = F.lit(False)
    for glob in globs:
        held = held | path.rlike(glob_pattern(glob))
    return F.coalesce(held & (path != ""), F.lit(False))


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)
