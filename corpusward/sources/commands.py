"""Install commands in prose: the packages that they would install."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Commands, flags, and words of the grammar.
JS_MANAGERS = {"npm", "pnpm", "yarn", "bun"}
JS_VERBS = {"install", "i", "add"}
JS_RUNNERS = {"npx", "pnpx", "bunx"}
VALUE_FLAGS = {"-r", "--requirement", "-c", "--constraint", "-i", "--index-url", "--extra-index-url", "-f", "--find-links", "-t", "--target", "-e", "--editable", "--prefix", "--registry", "--python", "--cache-dir"}
#: verbs that must follow a Python command, by command
PY_VERBS = {"pip": [["install"]], "pip3": [["install"]], "pipx": [["install"]], "poetry": [["add"]], "uv": [["add"], ["pip", "install"]]}
PATH_STARTS = ("./", "../", "/", "~", "git+", "file:", "github:", "npm:", "jsr:")
MANAGER = r"(?:npm|pnpm|yarn|bun|npx|pnpx|bunx|pip3?|uv|poetry|pipx)\s"
DOC_EXTENSIONS = ["md", "mdx", "mdc", "markdown", "txt", "yml", "yaml", "rules"]
DOC_NAMES = [".rules", ".windsurfrules", ".clinerules", ".aiderrules", ".agentrules"]
LONGEST_LINE, LONGEST_COMMAND, LONGEST_DOC = 500, 120, 512 * 1024
#: Words that stand in for a package's name. Fixed values.
PLACEHOLDERS = set(
    [
        "package", "package-name", "packagename", "pkg", "pkg-name", "name", "module", "module-name", "library",
        "lib", "dependency", "dependencies", "deps", "dep", "something", "anything", "yourpackage",
        "yourpackagename", "mypackage", "some-package", "any-package", "the-package", "new-package",
        "other-package", "package1", "package2",
    ]
)
#: Endings of files, signs and starts of words that stand in, versions, marks around commands. Fixed values.
FILE_ENDINGS = (".tgz", ".tar.gz", ".zip", ".whl", ".git", ".txt", ".json", ".toml", ".lock", ".yaml", ".yml")
NPM_NAME = re.compile(r"(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*", re.I)
PYPI_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")

_PLACEHOLDER_SIGNS = re.compile(r"""[<>{}[\]$%*?"'()=,]""")
_PLACEHOLDER_START = re.compile(r"(?:your|my|some|any|the)[-_]", re.I)
_VERSION = re.compile(r"[\^~=<>]|\d+(?:\.\d+)*\Z")
_NOISE = [(re.compile(r"^[\s>*+\-·•]+"), ""), (re.compile(r"^[`'\"]+"), ""), (re.compile(r"^\$\s+"), ""), (re.compile(r"^(?:RUN|CMD|ENTRYPOINT|run:|command:)\s+", re.I), ""), (re.compile(r"[`'\"]+\Z"), "")]


def bare_command(segment: str) -> str:
    """A command without list marks, prompts, quotes and image-file words."""
    for pattern, new in _NOISE:
        segment = pattern.sub(new, segment, count=1)
    return segment.strip()


def _is_no_name(token: str) -> bool:
    """Flags, paths, versions and file names aren't package names."""
    return not token or token[0] == "-" or token in (".", "..") or token.startswith(PATH_STARTS) or "://" in token or bool(_VERSION.match(token)) or token.lower().endswith(FILE_ENDINGS)


def _stands_in(name: str) -> bool:
    return bool(_PLACEHOLDER_SIGNS.search(name) or _PLACEHOLDER_START.match(name)) or name.lower() in PLACEHOLDERS


def npm_name(token: str) -> str | None:
    if _is_no_name(token):
        return None
    scope, slash, rest = token.partition("/") if token[0] == "@" else ("", "", token)
    if token[0] == "@" and not slash:
        return None
    at = rest.find("@", 0 if scope else 1)
    name = scope + slash + (rest if at < 0 else rest[:at])
    return None if _stands_in(name) or not NPM_NAME.fullmatch(name) or (not scope and "/" in name) else name


def pypi_name(token: str) -> str | None:
    if _is_no_name(token):
        return None
    name = re.split(r"[\[=<>!~;]", token, maxsplit=1)[0].strip()
    return name if name and not _stands_in(name) and PYPI_NAME.fullmatch(name) else None


def installed_by(command: str) -> tuple[str, list[str]] | None:
    """(ecosystem, names) of an install command; None if it is none."""
    tokens = command.split()
    if not tokens:
        return None
    head, rest = tokens[0].lower(), tokens[1:]
    if head in JS_RUNNERS:
        return "npm", _positional(rest, npm_name)[:1] if rest else []
    if head in JS_MANAGERS:
        return ("npm", [n for n in _positional(rest[1:], npm_name) if n]) if rest and rest[0].lower() in JS_VERBS else None
    for verbs in PY_VERBS.get(head, []):
        said = rest[: len(verbs)] if head == "uv" else [x.lower() for x in rest[: len(verbs)]]
        if said == verbs:
            return "pypi", [n for n in _positional(rest[len(verbs) :], pypi_name) if n]
    return None


def _positional(tokens: list[str], name_of) -> list[str | None]:
    """The name, or None, of each token that is neither a flag nor a flag's value."""
    out, skip = [], False
    for token in tokens:
        if skip:
            skip = False
        elif token in VALUE_FLAGS:
            skip = True
        elif not token.startswith("-"):
            out.append(name_of(token))
    return out


def _parsed(segments: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in segments:
        rows = []
        for segment in some:
            command = bare_command(segment)
            found = installed_by(command)
            rows.append((found[0] if found else None, [n for n in found[1] if n] if found else [], command[:LONGEST_COMMAND]))
        yield pd.DataFrame(rows, columns=["ecosystem", "names", "command"])


def is_doc(basename):
    """Files whose prose is read: by extension, or names that are nothing but one."""
    extension = F.lower(F.regexp_extract(basename, r"^.+\.([^.]*)$", 1))
    return basename.isin(DOC_NAMES) | extension.isin(DOC_EXTENSIONS)


def install_references(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, ecosystem, name, line, command: the first mention of each package in each document
    (keys, text). Only lines that name a package manager reach Python."""
    lines = docs.where(F.length("text") <= LONGEST_DOC).select(*keys, F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "said"))
    lines = lines.where((F.length("said") <= LONGEST_LINE) & F.col("said").rlike(MANAGER))
    segments = F.split(F.regexp_replace("said", r"(?U)\s+#\s.*$", ""), r"&&|\|\||;|\|", -1)
    parts = lines.select(*keys, (F.col("pos") + 1).alias("line"), F.posexplode(segments).alias("part", "segment"))
    parse = F.pandas_udf(_parsed, "ecosystem string, names array<string>, command string")
    parsed = parts.withColumn("x", parse("segment")).where("x.ecosystem is not null")
    named = parsed.select(*keys, "line", "part", "x.ecosystem", "x.command", F.posexplode("x.names").alias("n", "name"))
    least = F.min_by(F.struct("name", "line", "command"), F.struct("line", "part", "n")).alias("x")
    return named.groupBy(*keys, "ecosystem", F.lower("name").alias("_key")).agg(least).select(*keys, "ecosystem", "x.name", "x.line", "x.command")
