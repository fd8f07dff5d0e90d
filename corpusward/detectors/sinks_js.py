"""Risky calls, pairs, assignments and attributes of JavaScript and TypeScript: filters over rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SQL_VERB = r"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|WITH|REPLACE|MERGE)\b"
SQL_RUNNERS = ["query", "querySync", "execute", "executeSync", "raw", "sequelize"]
UNSAFE_SQL = ["$queryRawUnsafe", "$executeRawUnsafe"]
VM_RUNNERS = ["runInThisContext", "runInNewContext", "runInContext", "compileFunction"]
SHELL_RUNNERS = ["exec", "execSync", "execFile", "execFileSync", "spawn", "spawnSync"]
ORIGIN_HEADER = ["Access-Control-Allow-Origin", "access-control-allow-origin"]
_STAR, _PLAIN = r"^[\"'`]\*[\"'`]$", r"^(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)$"


def rules() -> list[tuple[str, str, str, Column]]:
    """kind, rule, severity, and what holds of a row that it flags."""
    c = F.col
    call = lambda *names: (c("what") == "call") & c("name").isin(*names)
    prop = lambda name: F.try_element_at("props", F.lit(name))
    hit = lambda kind, rule, severity, held: (kind, rule, severity, held)
    shell = (call("exec", "execSync") & c("dynamic")) | (call(*SHELL_RUNNERS) & (prop("shell") == "true") & c("any_dynamic"))
    header = F.regexp_replace("first", r"^[\"'`]|[\"'`]$", "").isin(ORIGIN_HEADER)
    inner = F.trim(F.regexp_extract("first", r"(?s)__html\s*:\s*(.+?)\s*$", 1))
    return [
        hit("shell", "shell-js-dynamic-command", "critical", shell & c("shell_bound")),
        hit("sql", "sql-js-dynamic-query", "critical", call(*SQL_RUNNERS) & c("dynamic") & c("literal").rlike(SQL_VERB)),
        hit("sql", "sql-js-prisma-unsafe", "critical", call(*UNSAFE_SQL) & (c("first") != "")),
        hit("cors", "cors-star", "high", call("cors") & prop("origin").rlike(_STAR)),
        hit("cors", "cors-reflect", "high", call("cors") & (prop("origin") == "true")),
        hit("cors", "cors-header-star", "high", (c("what") == "pair") & c("name").isin(ORIGIN_HEADER) & c("first").rlike(_STAR)),
        hit("cors", "cors-setheader-star", "high", call("setHeader", "header", "set") & header & c("second").rlike(_STAR)),
        hit("tls", "tls-reject-unauthorized-false", "critical", (c("what") == "pair") & (c("name") == "rejectUnauthorized") & (c("first") == "false")),
        hit("tls", "tls-env-reject-unauthorized", "critical", (c("what") == "assign") & F.contains("name", F.lit("NODE_TLS_REJECT_UNAUTHORIZED")) & F.contains("first", F.lit("0"))),
        hit("code-exec", "code-exec-js", "critical", call("eval", "Function", *VM_RUNNERS) & c("dynamic")),
        hit("xss", "xss-innerhtml-assign", "high", (c("what") == "assign") & c("name").rlike(r"\.(?:innerHTML|outerHTML)$") & (c("any_dynamic") | (c("literal") == "") & ~c("first").rlike(_PLAIN) | c("first").startswith("`"))),
        hit("xss", "xss-document-write", "high", call("write", "writeln") & F.contains("callee", F.lit("document.write")) & c("dynamic")),
        hit("xss", "xss-dangerously-set-inner-html", "high", (c("what") == "jsx") & ~inner.rlike(_PLAIN)),
        hit("deserialization", "deser-js-unserialize", "critical", (c("what") == "call") & ((c("name") == "unserialize") | F.contains("callee", F.lit("node-serialize")))),
    ]

