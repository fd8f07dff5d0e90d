"""Package names, specifiers and install commands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column, ecosystem: Column) -> Column:
    """Trimmed and lower-cased; on PyPI runs of - _ . become one -."""
    low = F.lower(F.trim(name))
    return F.when(ecosystem == "pypi", F.regexp_replace(low, "[-_.]+", "-")).otherwise(low)


def distance_limit(name: Column) -> Column:
    """The edit distance up to which a name resembles another one."""
    return F.when(F.length(name) >= 6, 2).otherwise(1)


# Modules of the JavaScript runtimes and of Python's library.
NODE_MODULES = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net",
    "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream",
    "string_decoder", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads",
    "zlib", "fs/promises", "dns/promises", "stream/promises", "timers/promises", "readline/promises", "deno",
]
PYTHON_MODULES = [
    "abc", "argparse", "array", "asyncio", "base64", "bisect", "builtins", "calendar", "collections", "contextlib",
    "copy", "csv", "ctypes", "dataclasses", "datetime", "decimal", "enum", "functools", "gc", "getpass", "glob",
    "hashlib", "heapq", "hmac", "html", "http", "importlib", "inspect", "io", "itertools", "json", "logging",
    "math", "multiprocessing", "operator", "os", "pathlib", "pickle", "platform", "pprint", "queue", "random",
    "re", "secrets", "shutil", "signal", "socket", "sqlite3", "ssl", "statistics", "string", "struct",
    "subprocess", "sys", "tempfile", "threading", "time", "timeit", "traceback", "typing", "unittest", "urllib",
    "uuid", "warnings", "weakref", "xml", "zipfile", "zlib",
]


def is_local_specifier(spec: Column) -> Column:
    return F.trim(spec).rlike(r"^(?:\./|\.\./|/|\\|file:|[A-Za-z]:[/\\])")


def is_runtime_module(spec: Column) -> Column:
    name = F.trim(spec)
    return name.rlike("^(?:node|bun|deno):") | name.isin(NODE_MODULES)


def package_of_specifier(spec: Column) -> Column:
    """The package that an import names: null for local paths and runtime modules, #alias for package
    imports, scope and name for scoped packages, @/... as it is, else the first segment."""
    part = F.split(spec, "/")
    first, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    return (
        F.when((spec == "") | is_local_specifier(spec) | is_runtime_module(spec), F.lit(None).cast("string"))
        .when(spec.startswith("#"), first)
        .when(spec.startswith("@") & second.isNull(), F.lit(None).cast("string"))
        .when(spec.startswith("@") & ((first == "@") | (second == "")), spec)
        .when(spec.startswith("@"), F.concat_ws("/", first, second))
        .otherwise(first)
    )


#: Specifiers in a manifest that name no registry package. Fixed value.
NOT_REGISTRY = r"(?i)^(?:git[+:]|github:|gitlab:|bitbucket:|file:|link:|portal:|workspace:|catalog:|https?://|ssh:|\.{1,2}/)"


def registry_name(key: Column, spec: Column) -> Column:
    """The registry's name of a manifest entry: null for other protocols, the target of an npm: alias."""
    spec = F.trim(F.coalesce(spec, F.lit("")))
    target = F.trim(F.substring(spec, 5, 10_000))
    found = F.when(target.startswith("@"), F.regexp_extract(target, "^(@[^/]*/[^@]*)", 1)).otherwise(F.regexp_extract(target, "^(.[^@]*)", 1))
    return F.when(spec.rlike(NOT_REGISTRY), F.lit(None).cast("string")).when(spec.rlike("(?i)^npm:"), F.nullif(found, F.lit(""))).otherwise(key)


def matches_pattern(pattern: Column, spec: Column) -> Column:
    """A path alias with at most one *: it must stand for something if there is text on both sides."""
    star = F.instr(pattern, "*")
    prefix = F.substring(pattern, F.lit(1), star - 1)
    suffix = F.substring(pattern, star + 1, F.length(pattern))
    middle = F.length(spec) - F.length(prefix) - F.length(suffix)
    both = (F.length(prefix) > 0) & (F.length(suffix) > 0)
    wild = spec.startswith(prefix) & spec.endswith(suffix) & (middle >= 0) & ~((middle == 0) & both)
    return F.when(star == 0, pattern == spec).otherwise(wild)
