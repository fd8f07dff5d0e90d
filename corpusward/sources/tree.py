"""Source trees as a table: one row for each file of each repository.

Spark's own file sources leave out names that begin with . or _, which are the ones that matter
here; so this is a data source of its own. Filters on repository, path, name, extension, size and walk
come to the source: files that they leave out are listed but not opened. A few repositories are cut into shares of their top-level
entries, many are taken whole, and partitions get several each; executors do all of the listing.
A row says which of the two walks reaches the file: the text walk (configuration and sources of
bounded size) or the package walk (manifests, imports, docs). Contents are only read on request.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

# What the walks leave out.
PACKAGE_SKIPPED = frozenset([
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "coverage", "__pycache__", ".venv", "venv",
    ".tox",
])
TEXT_SKIPPED = PACKAGE_SKIPPED | {".cache", "vendor"}
TEXT_DOT_FOLDERS = frozenset((".github", ".vscode", ".idea"))
#: Where provenance records stand; listed apart from both walks.
TRACES = ".agent-trace"
BINARY_ENDINGS = frozenset([
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4",
    ".zip", ".gz", ".tar", ".7z", ".pdf", ".wasm", ".map", ".lock", ".pyc", ".class", ".o", ".so", ".dll", ".exe",
])
LOCK_FILES = frozenset([
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "Cargo.lock", "poetry.lock",
    "composer.lock",
])
LARGEST_TEXT = 512 * 1024
#: Shares of a repository at most, and partitions of all.
SHARES, PARTITIONS = 4, 2048

SCHEMA = "repo_id string, path string, basename string, ext string, size long, content binary, in_text_walk boolean, in_package_walk boolean, issue_code string, issue_message string"


def _extension(name: str) -> str:
    stem, dot, ending = name.rpartition(".")
    return dot + ending.lower() if stem and stem.strip(".") else ""


#: What the source can tell before it opens a file: a row's place by column.
_TOLD = {"repo_id": 0, "path": 1, "basename": 2, "ext": 3, "size": 4, "in_text_walk": 6, "in_package_walk": 7}
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a,
}


class _Part(InputPartition):
    """Shares of repositories: id, folder, number of the share, shares of that repository."""

    def __init__(self, shares: list[tuple[str, str, int, int]]):
        self.shares = shares


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.repos = json.loads(options["repos"])
        self.with_content = options.get("content", "true").lower() == "true"
        self.largest = int(options.get("largest", LARGEST_TEXT))
        self.shares = max(1, int(options.get("shares", SHARES)))
        self.filters: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes what _TOLD can answer; Spark applies the rest."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _TOLD:
                self.filters.append((_TOLD[f.attribute[0]], type(f), f.value))
            else:
                yield f

    def _wanted(self, row: tuple) -> bool:
        """Nothing is compared with a null, and such a row goes."""
        return all(row[k] is not None and _TESTS[kind](row[k], value) for k, kind, value in self.filters)

    def _repos(self) -> dict[str, str]:
        own = [(kind, value) for k, kind, value in self.filters if k == 0]
        return {r: root for r, root in self.repos.items() if all(_TESTS[kind](r, value) for kind, value in own)}

    def partitions(self):
        repos = self._repos()
        of = max(1, min(self.shares, PARTITIONS // max(1, len(repos))))
        shares = [(repo, root, k, of) for repo, root in repos.items() for k in range(of)]
        return [_Part(shares[k::PARTITIONS]) for k in range(min(PARTITIONS, len(shares)))] or [_Part([])]

    def read(self, part):
        return filter(self._wanted, self._rows(part)) if self.filters else self._rows(part)

    def _rows(self, part):
        for repo, root, share, of in part.shares:
            try:
                entries = sorted(os.listdir(root))
            except OSError:
                if share == 0:
                    for walk in ("text", "package"):
                        yield self._issue(repo, ".", walk, True)
                continue
            for entry in entries[share::of]:
                yield from self._visit(repo, root, entry, True, True)

    def _issue(self, repo: str, path: str, walk: str, folder: bool):
        code = f"{'text' if walk == 'text' else 'ghost-deps'}-walk-{'directory' if folder else 'stat'}-failed"
        said = f'Could not {"enumerate directory" if folder else "inspect"} "{path}".'
        return (repo, path, path.rpartition("/")[2], "", None, None, walk == "text", walk == "package", code, said)

    @staticmethod
    def _unread(repo: str, path: str, walk: str):
        code = f"{'text' if walk == 'text' else 'ghost-deps'}-read-failed"
        return (repo, path, path.rpartition("/")[2], "", None, None, walk == "text", walk == "package", code, f'Could not read "{path}".')

    def _traces(self, repo: str, root: str) -> Iterator[tuple]:
        """Provenance records; those that can't be read are left out without an issue."""
        try:
            names = sorted(os.listdir(os.path.join(root, TRACES)))
        except OSError:
            return
        for name in names:
            full = os.path.join(root, TRACES, name)
            seen = (repo, f"{TRACES}/{name}", name, _extension(name), 0, None, False, False)
            if name.endswith((".json", ".jsonl")) and os.path.isfile(full) and not os.path.islink(full) and all(_TESTS[kind](seen[k], value) for k, kind, value in self.filters if k != 4):
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                yield (repo, f"{TRACES}/{name}", name, _extension(name), len(content), content, False, False, None, None)

    def _visit(self, repo: str, root: str, path: str, text: bool, package: bool) -> Iterator[tuple]:
        name, full = path.rpartition("/")[2], os.path.join(root, path)
        text, package = text and name not in TEXT_SKIPPED, package and name not in PACKAGE_SKIPPED
        if not (text or package) or os.path.islink(full):
            return
        if os.path.isdir(full):
            if name.startswith("."):
                text, package = text and name in TEXT_DOT_FOLDERS, False
            if path == TRACES:
                yield from self._traces(repo, root)
            if not (text or package):
                return
            try:
                entries = sorted(os.listdir(full))
            except OSError:
                yield from (self._issue(repo, path, walk, True) for walk, on in (("text", text), ("package", package)) if on)
                return
            for entry in entries:
                yield from self._visit(repo, root, f"{path}/{entry}", text, package)
        elif os.path.isfile(full):
            try:
                size = os.stat(full).st_size
            except OSError:
                if text:
                    yield self._issue(repo, path, "text", False)
                return
            ext = _extension(name)
            text = text and name not in LOCK_FILES and ext not in BINARY_ENDINGS and 0 < size <= self.largest
            if not (text or package):
                return
            content = None
            if self.with_content and self._wanted((repo, path, name, ext, size, None, text, package)):
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                except OSError:
                    yield from (self._unread(repo, path, walk) for walk, on in (("text", text), ("package", package)) if on)
            yield (repo, path, name, ext, size, content, text, package, None, None)


class SourceTree(DataSource):
    """Option repos: a JSON object of repository ids and folders that all executors see.
    Option content: false for a listing without contents. Option largest: bytes of a file in the text walk.
    Option shares: how many tasks a repository's top-level entries are dealt to; more for a large one."""

    @classmethod
    def name(cls):
        return "sourcetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_trees(spark: SparkSession, repos: dict[str, str], content: bool = True, largest: int = LARGEST_TEXT) -> DataFrame:
    """The files and the walks' issues of repositories, by id and folder."""
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a source that takes filters
    return spark.read.format("sourcetree").option("repos", json.dumps(repos)).option("content", str(content).lower()).option("largest", str(largest)).load()
