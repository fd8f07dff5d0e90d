"""Risky calls of Python sources: each rule is a filter over the table of calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHELL_RUNNERS = ["run", "call", "Popen", "check_output", "check_call", "getoutput", "getstatusoutput"]
SQL_RUNNERS = ["execute", "executemany", "executescript"]
SQL_VERB = r"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|WITH|REPLACE|MERGE)\b"


def rules() -> list[tuple[str, str, str, Column]]:
    """kind, rule, severity, and what holds of a call that it flags."""
    last = F.element_at(F.split("callee", r"\."), -1)
    module = F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)
    kw = lambda name: F.try_element_at("kwargs", F.lit(name))
    hit = lambda kind, rule, held, severity="critical": (kind, rule, severity, held)
    dynamic = F.col("arg0_dynamic")
    given = F.exists(F.map_values("kwargs"), lambda v: v.rlike(r"(?:^|\.)CERT_NONE$"))
    return [
        hit("shell", "py-os-system", (last == "system") & (module != "") & dynamic),
        hit("shell", "py-subprocess-shell", last.isin(SHELL_RUNNERS) & (kw("shell") == "True") & dynamic),
        hit("sql", "py-sql-execute", last.isin(SQL_RUNNERS) & dynamic & F.col("arg0_literal").rlike(SQL_VERB)),
        hit("tls", "py-verify-false", kw("verify") == "False"),
        hit("tls", "py-ssl-false", kw("ssl") == "False", "high"),
        hit("tls", "py-cert-none", given | F.col("text").rlike(r"\bCERT_NONE\b")),
        hit("code-exec", "py-eval", last.isin("eval", "exec", "compile") & dynamic),
        hit("deserialization", "py-pickle", (F.element_at(F.split(module, r"\."), -1).isin("pickle", "cPickle", "_pickle")) & last.isin("load", "loads")),
        hit("deserialization", "py-yaml-load", F.col("callee") == "yaml.load", "high"),
    ]
