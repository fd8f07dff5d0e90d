"""What git knows of repositories, asked by executors: one row in, the answers of one repository out.

Each repository takes a few git processes, whatever its number of paths; the driver starts none."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that ask git, at most.
TASKS = 2048
_CHANGED = ("--name-only", "--diff-filter=ACMR", "-z", "--relative")


def _git(root: str, *args: str, given: str | None = None, codes: tuple[int, ...] = (0,)) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120, errors="replace", input=given)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode in codes else None


def _names(listed: str | None) -> list[str]:
    return [x for x in (listed or "").split("\0") if x]


def is_toplevel(root: str) -> bool:
    top = _git(root, "rev-parse", "--show-toplevel")
    return bool(top) and os.path.realpath(top.strip()).lower() == os.path.realpath(root).lower()


def folders(spark: SparkSession, repos: dict[str, str]) -> DataFrame:
    """repo_id, root of repositories by id and folder, some to a task."""
    rows = spark.createDataFrame(list(repos.items()), "repo_id string, root string")
    return rows.repartition(max(1, min(TASKS, len(repos))), "repo_id")


def commits(spark: SparkSession, repos: dict[str, str], last: int = 50) -> DataFrame:
    """repo_id, body of the last commits of repositories whose folder is git's top level."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for repo, root in zip(some.repo_id, some.root):
                bodies = _names(_git(root, "log", "-n", str(last), "--format=%B%x00")) if is_toplevel(root) else []
                yield pd.DataFrame([(repo, b) for b in bodies if b.strip()], columns=["repo_id", "body"])

    return folders(spark, repos).mapInPandas(ask, "repo_id string, body string")


def env_files(spark: SparkSession, repos: dict[str, str], paths: DataFrame) -> DataFrame:
    """repo_id, path, tracked, ignored (null where the folder isn't git's top level) of the paths
    (repo_id, path), for Tables.git_files. Paths of a repository are asked for together."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for (repo, root), of_repo in some.groupby(["repo_id", "root"]):
                wanted = "\0".join(of_repo.path)
                tracked = {*_names(_git(root, "ls-files", "-z", "--", *of_repo.path))}
                ignored = {*_names(_git(root, "check-ignore", "--no-index", "-z", "--stdin", given=wanted, codes=(0, 1)))} if is_toplevel(root) else None
                yield pd.DataFrame([(repo, p, p in tracked, None if ignored is None else p in ignored) for p in of_repo.path], columns=["repo_id", "path", "tracked", "ignored"])

    asked = paths.select("repo_id", "path").join(folders(spark, repos), "repo_id").repartition(max(1, min(TASKS, len(repos))), "repo_id").sortWithinPartitions("repo_id")
    return asked.mapInPandas(ask, "repo_id string, path string, tracked boolean, ignored boolean")


def changed_files(spark: SparkSession, repos: dict[str, str], base: str | None = None) -> DataFrame:
    """repo_id, path, failed of files added, copied, modified or renamed since base (if one is given), in
    the index, in the folder, or untracked. A repository that can't be compared has one row: failed
    says why, and path is null."""

    def changed(root: str) -> list[tuple[str | None, str | None]]:
        lists = [_git(root, "diff", *_CHANGED), _git(root, "diff", *_CHANGED, "--cached"), _git(root, "ls-files", "--others", "--exclude-standard", "-z")]
        if base is not None:
            lists.append(_git(root, "diff", *_CHANGED, f"{base}...HEAD"))
        if lists[-1] is None:
            return [(None, f"Cannot compare {root} with {base}." if base else f"{root} is no git repository.")]
        return [(x, None) for x in sorted({x for some in lists for x in _names(some)})]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for repo, root in zip(some.repo_id, some.root):
                yield pd.DataFrame([(repo, *x) for x in changed(root)], columns=["repo_id", "path", "failed"])

    return folders(spark, repos).mapInPandas(ask, "repo_id string, path string, failed string")


def comparable(changed: DataFrame) -> DataFrame:
    """changed_files without failures; one of these is an error."""
    changed = changed.persist()
    failed = changed.where(F.col("failed").isNotNull()).first()
    if failed:
        raise ValueError(failed.failed)
    return changed.select("repo_id", "path")
