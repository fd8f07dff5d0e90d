"""Risky calls in Python, JavaScript and TypeScript sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.detectors import js_calls, python_calls, sinks_js, sinks_python
from corpusward.functions.text import snippet
from corpusward.schemas import Found, Tables, findings, language

ID = "dangerous-sinks"
#: kind: title, why, what to do
TOLD = {
    "shell": ("Shell command with run-time parts", "Text from elsewhere may end up as a command.", "Pass a list of arguments, without a shell."),
    "sql": ("SQL with run-time parts", "Text from elsewhere may change the statement.", "Pass values as parameters."),
    "tls": ("Certificates aren't verified", "Anyone on the way can read and change the traffic.", "Leave verification on."),
    "code-exec": ("Run-time text is run as code", "Text from elsewhere may be run.", "Parse the data instead of evaluating it."),
    "deserialization": ("Unsafe deserialisation", "Loading such data may run code from it.", "Use a format that holds data only."),
    "cors": ("Any origin may read responses", "Pages of other sites can read what a visitor may see.", "List the origins that need access."),
    "xss": ("HTML from run-time text", "Text from elsewhere may run in a visitor's browser.", "Set text content, or sanitise the HTML."),
}


def flagged(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """rows with kind, rule, severity: one for each rule that flags it, in one pass over rows."""
    one = lambda kind, rule, severity: F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    hits = F.array_compact(F.array(*[F.when(held, one(kind, rule, severity)) for kind, rule, severity, held in rules]))
    made = rows.withColumn("_hit", F.explode(hits))
    return made.select("repo_id", "path", "line", "col", "text", F.col("_hit")["kind"].alias("kind"), F.col("_hit")["rule"].alias("rule"), F.col("_hit")["severity"].alias("severity"))


def spread(files: DataFrame) -> DataFrame:
    """files over as many tasks as a shuffle has, each once. Small tables are few partitions, and parsing
    takes a hundred times as long as moving a text."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo_id", "path")


def detect(tables: Tables) -> Found:
    files = tables.files.where("in_text_walk and issue_code is null and text is not null").withColumn("lang", language(F.col("ext"))).where("lang is not null").select("repo_id", "path", "text", "lang")
    py = python_calls.parsed(spread(files.where("lang = 'python'")))
    js = js_calls.parsed(spread(files.where("lang <> 'python'")))
    calls = py.select("repo_id", "path", F.explode("p.calls").alias("c")).select("repo_id", "path", "c.*")
    others = js.select("repo_id", "path", F.explode("p.rows").alias("c")).select("repo_id", "path", "c.*")
    rows = flagged(calls, sinks_python.rules()).unionByName(flagged(others, sinks_js.rules()))
    told = lambda k: reduce(lambda w, x: w.when(F.col("kind") == x[0], F.lit(x[1][k])), TOLD.items(), F.when(F.lit(False), ""))
    at = F.concat_ws(":", F.col("path"), F.col("line"))
    made = findings(
        rows,
        id=F.concat_ws(":", F.lit(ID), "rule", "path", "line", "col"),
        detector_id=ID,
        title=told(0),
        explanation=told(1),
        fix_prompt=F.concat(told(2), F.lit(" See "), at, F.lit(".")),
        file=F.col("path"),
        evidence=snippet(F.col("text")),
        metadata=F.to_json(F.struct("kind", F.col("rule").alias("ruleId"))),
    )
    failed = py.where("p.failed").select("repo_id", "path").unionByName(js.where("p.failed").select("repo_id", "path"))
    issues = failed.select("repo_id", F.lit(ID).alias("detector_id"), F.lit("dangerous-sinks-parse-failed").alias("code"), F.concat(F.lit('Could not parse "'), F.col("path"), F.lit('".')).alias("message"), F.col("path").alias("file"))
    return Found(made, issues, files.select("repo_id", "path"))
