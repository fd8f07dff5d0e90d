"""Lines that provenance records give to AI tools and that no human is recorded for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusward.operators import ranges
from corpusward.schemas import Found, Tables, findings

ID = "ai-unreviewed"
# Fixed values.
_MARK = r"(?im)^\s*(?:(?:\/\/|#|\/\*+|\*)\s*)?"
DISCLOSED = _MARK + r"SPDX-AI-Disclosure:\s*ai-generated\b"
REVIEWED = _MARK + r"SPDX-AI-(?:Reviewed|ReviewStatus|Human-Reviewed):\s*(?:yes|true|reviewed|human)\b"
KINDS = ["human", "ai", "mixed", "unknown"]
HEADER_BYTES = 4096
_WHO = "contributor:struct<type:string,model_id:string>"
_RECORD = f"version string, id string, files array<struct<path:string,conversations:array<struct<{_WHO},ranges:array<struct<start_line:double,end_line:double,{_WHO}>>>>>>"


def trace_ranges(files: DataFrame) -> DataFrame:
    """repo_id, file, start, end, contributor, model, source, origin of provenance records."""
    traces = files.where("path like '.agent-trace/%' and text is not null")
    lines = traces.where("ext = '.jsonl'").select("repo_id", "path", F.explode(F.split("text", r"\r?\n")).alias("json"))
    whole = traces.where("ext = '.json'").select("repo_id", "path", F.col("text").alias("json"))
    record = lambda some: some.withColumn("r", F.from_json("json", _RECORD))
    rows = record(lines).unionByName(record(whole).where("r.version is not null and r.files is not null"))
    rows = rows.select("repo_id", "path", F.explode("r.files").alias("f")).where("f.path is not null and f.path <> ''")
    rows = rows.select("repo_id", "path", F.replace("f.path", F.lit("\\"), F.lit("/")).alias("file"), F.explode("f.conversations").alias("c"))
    rows = rows.select("repo_id", "path", "file", F.col("c.contributor").alias("by"), F.explode("c.ranges").alias("x")).where("x.start_line >= 1 and x.end_line >= x.start_line")
    kind = lambda c: F.when(c.isin(KINDS), c)
    who = F.coalesce(kind(F.col("x.contributor.type")), kind(F.col("by.type")), F.lit("ai"))
    return rows.select("repo_id", "file", F.col("x.start_line").cast("int").alias("start"), F.col("x.end_line").cast("int").alias("end"), who.alias("contributor"), F.coalesce("x.contributor.model_id", "by.model_id").alias("model"), F.lit("agent-trace").alias("source"), F.col("path").alias("origin"))


def disclosed_ranges(files: DataFrame) -> DataFrame:
    head = F.expr(f"make_valid_utf8(cast(substring(content, 1, {HEADER_BYTES}) AS string))")
    some = files.where("in_text_walk and content is not null").withColumn("head", head).where(F.col("head").rlike(DISCLOSED) & ~F.col("head").rlike(REVIEWED))
    end = F.size(F.split("text", "\n", -1)).cast("int")
    return some.select("repo_id", F.col("path").alias("file"), F.lit(1).alias("start"), end.alias("end"), F.lit("ai").alias("contributor"), F.lit(None).cast("string").alias("model"), F.lit("spdx-ai-disclosure").alias("source"), F.col("path").alias("origin"))


def detect(tables: Tables) -> Found:
    given = trace_ranges(tables.files).unionByName(disclosed_ranges(tables.files))
    left = ranges.subtract(given.where("contributor = 'ai'"), given.where("contributor in ('human', 'mixed')"), "repo_id", "file", spread=False)  # keys are files, whose records are few
    by_file = left.groupBy("repo_id", "file").agg(ranges.line_count(F.col("start"), F.col("end")).cast("long").alias("lines"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    about = given.groupBy("repo_id", "file").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("contributor") == "ai", F.col("model")))).alias("models"))
    rows = by_file.join(about, ["repo_id", "file"]).withColumn("severity", F.when(F.col("lines") >= 80, "medium").when(F.col("lines") >= 20, "low").otherwise("info"))
    actionable = F.bool_or(F.col("severity") != "info").over(Window.partitionBy("repo_id"))
    rows = rows.withColumn("any", actionable).where("not any or severity <> 'info'").withColumn("said", ranges.formatted(F.col("r")))
    first, last = F.get("r", F.lit(0)), F.element_at("r", -1)
    made = findings(
        rows,
        id=F.concat(F.lit(f"{ID}:"), F.col("file"), F.lit(":"), first["start"], F.lit("-"), last["end"]),
        detector_id=ID,
        title=F.concat(F.col("lines"), F.lit(" AI-written lines that nobody reviewed: "), F.col("file")),
        explanation=F.concat(F.array_join("sources", ", "), F.lit(" gives the lines "), F.col("said"), F.lit(" to AI tools, and none to a human afterwards.")),
        fix_prompt=F.concat(F.lit("Review the lines "), F.col("said"), F.lit(" of "), F.col("file"), F.lit(" and record the review.")),
        line=first["start"],
        evidence=F.concat(F.lit("L"), F.col("said"), F.lit(" ("), F.col("lines"), F.lit(" lines)")),
        metadata=F.to_json(F.struct(F.array_join("sources", ", ").alias("engine"), F.col("r").alias("unreviewedRanges"), F.col("lines").alias("lineCount"), "models")),
    )
    skips = tables.repos.join(given.select("repo_id").distinct(), "repo_id", "left_anti").select("repo_id", F.lit("No provenance records or disclosures were found.").alias("reason"))
    return Found(made, analysed=given.select("repo_id", F.col("file").alias("path")).distinct(), skips=skips)
