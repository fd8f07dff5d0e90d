"""Explicit signs of AI tools: a disclosure file, commit trailers, file header markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusward.operators.regexscan import matches, scan
from corpusward.schemas import Found, Tables, findings

ID = "ai-presence"
# Fixed values.
TRAILER = r"(?im)^(?:Co-Authored-By:\s*(?:.+)|Made-with:\s*(?:Cursor|Claude|Copilot|Windsurf|Aider|Codex)|Generated with\s+(?:Claude Code|Cursor|GitHub Copilot)|Generated by\s+(?:Cursor|Claude|Copilot|ChatGPT))"
MARKER = r"(?im)^\s*(?:(?:\/\/|#|\/\*+|\*)\s*)?(?:SPDX-AI-Disclosure:\s*\S+|Generated (?:by|with)\s+(?:Cursor|Claude|Copilot|Codex|ChatGPT|Windsurf|Aider)|Co-Authored-By:\s*(?:Claude|Cursor|Copilot|GPT))"
DISCLOSURE, HEADER_BYTES = "AI_DISCLOSURE.md", 2048


def short_hash(text: Column) -> Column:
    """The 32-bit polynomial hash of the text's UTF-16 units, its absolute value in base 36."""
    return F.lower(F.conv(F.abs(F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("int").cast("long")).cast("string"), 10, 36))


def detect(tables: Tables) -> Found:
    files = tables.files.where("issue_code is null and content is not null")
    disclosed = files.where(F.col("path") == DISCLOSURE)
    made = findings(disclosed, id=f"{ID}:disclosure-md", detector_id=ID, severity="info", title=f"{DISCLOSURE} found", explanation="The repository discloses its use of AI tools.", fix_prompt=f"Keep {DISCLOSURE} up to date.", file=F.col("path"), evidence=F.regexp_replace(F.substring("text", 1, 80), r"\s+", " "), metadata='{"source":"ai-disclosure-md"}')
    walked = files.where("in_text_walk").withColumn("head", F.expr(f"make_valid_utf8(cast(substring(content, 1, {HEADER_BYTES}) AS string))"))
    marked = walked.where(F.col("head").rlike(MARKER)).withColumn("m", F.get(matches(F.col("head"), {ID: MARKER}), F.lit(0)))
    made = made.unionByName(
        findings(marked, id=F.concat(F.lit(f"{ID}:file:"), F.col("path"), F.lit(":"), short_hash(F.col("m.match"))), detector_id=ID, severity="info", title=F.concat(F.lit("AI marker in "), F.col("path")), explanation="The file says that an AI tool made or helped to make it.", fix_prompt=F.concat(F.lit("Review "), F.col("path"), F.lit(" by hand.")), file=F.col("path"), line=F.col("m.line"), evidence=F.trim("m.match"), metadata='{"source":"file-marker"}')
    )
    if tables.commits is not None:
        said = scan(tables.commits.select("repo_id", "body"), TRAILER, "body").select("repo_id", F.trim("match").alias("evidence")).distinct()
        made = made.unionByName(
            findings(said, id=F.concat(F.lit(f"{ID}:trailer:"), short_hash(F.col("evidence"))), detector_id=ID, severity="info", title=F.concat(F.lit("AI trailer in a commit: "), F.substring("evidence", 1, 60)), explanation="A commit message names an AI tool.", fix_prompt="Have what the commit brought reviewed.", metadata='{"source":"git-trailer"}')
        )
    return Found(made, analysed=walked.select("repo_id", "path").unionByName(disclosed.select("repo_id", "path")))
