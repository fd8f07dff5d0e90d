"""Policies: what fails a scan, and what is ignored."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import DataFrame, SparkSession

from corpusward.functions.text import glob_pattern
from corpusward.operators.scoring import WEIGHTS

FILES = ("corpusward.yml", "corpusward.yaml", "corpusward.json")


@dataclass(frozen=True)
class Policy:
    minimum_score: int | None = None
    fail_on: tuple[str, ...] = ()
    fail_on_incomplete: bool = False
    ignore_detectors: tuple[str, ...] = ()
    ignore_findings: tuple[str, ...] = ()
    ignore_paths: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)

    def merged(self, **over) -> Policy:
        """Values that are given take over; None leaves what the file says."""
        return replace(self, **{k: v for k, v in over.items() if v is not None})


def _strings(value, name: str, path: str) -> tuple[str, ...]:
    if not isinstance(value, list) or any(not isinstance(x, str) or not x for x in value):
        raise ValueError(f"Invalid policy ({path}): {name} must be a list of strings.")
    return tuple(value)


def parse(raw, path: str = "policy") -> Policy:
    """A policy from parsed YAML or JSON; anything unknown is an error."""
    if not isinstance(raw, dict) or not raw and raw != {}:
        raise ValueError(f"Invalid policy ({path}): expected an object.")
    unknown = [k for k in raw if k not in ("minimumScore", "failOn", "failOnIncomplete", "ignore")]
    if unknown:
        raise ValueError(f"Invalid policy ({path}): unknown keys: {', '.join(map(str, unknown))}.")
    score = raw.get("minimumScore")
    if "minimumScore" in raw and (isinstance(score, bool) or not isinstance(score, int) or not 0 <= score <= 100):
        raise ValueError(f"Invalid policy ({path}): minimumScore must be an integer from 0 to 100.")
    fail_on = _strings(raw["failOn"], "failOn", path) if "failOn" in raw else ()
    if wrong := [x for x in fail_on if x not in WEIGHTS]:
        raise ValueError(f"Invalid policy ({path}): unknown severities: {', '.join(wrong)}.")
    incomplete = raw.get("failOnIncomplete", False)
    if not isinstance(incomplete, bool):
        raise ValueError(f"Invalid policy ({path}): failOnIncomplete must be a boolean.")
    ignore = raw.get("ignore", {})
    if not isinstance(ignore, dict):
        raise ValueError(f"Invalid policy ({path}): ignore must be an object.")
    if unknown := [k for k in ignore if k not in ("detectors", "findings", "paths")]:
        raise ValueError(f"Invalid policy ({path}): unknown ignore keys: {', '.join(map(str, unknown))}.")
    lists = {f"ignore_{k}": _strings(v, f"ignore.{k}", path) for k, v in ignore.items()}
    return Policy(score, fail_on, incomplete, **lists)


def load(root: str, path: str | None = None) -> Policy:
    """The policy at path, or the first of FILES in root, or an empty one."""
    for name in [path] if path else [os.path.join(root, f) for f in FILES]:
        try:
            with open(name, encoding="utf-8") as f:
                return parse(yaml.safe_load(f), name)
        except FileNotFoundError:
            continue
    if path:
        raise ValueError(f"Policy not found: {path}")
    return Policy()


def table(spark: SparkSession, policies: dict[str, Policy], fallback: int = 85) -> DataFrame:
    """The policies of repositories, a row each: repo_id, minimum_score, fail_on, fail_on_incomplete,
    ignore_detectors, ignore_findings, and ignore_paths, one regular expression for all of its globs."""
    path = lambda globs: "|".join(f"(?:{glob_pattern(g)})" for g in globs) or None
    rows = [(repo, fallback if p.minimum_score is None else p.minimum_score, list(p.fail_on), p.fail_on_incomplete, list(p.ignore_detectors), list(p.ignore_findings), path(p.ignore_paths)) for repo, p in policies.items()]
    return spark.createDataFrame(rows, "repo_id string, minimum_score int, fail_on array<string>, fail_on_incomplete boolean, ignore_detectors array<string>, ignore_findings array<string>, ignore_paths string")
