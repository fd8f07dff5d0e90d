"""Hazards of the root package.json: scripts that run remote code, dependencies over plain HTTP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusward.schemas import Found, Tables, findings

ID = "supply-chain"
# Fixed values.
REMOTE_CODE = r"(?i)curl\s+[^\n|]*\|\s*(?:ba)?sh|wget\s+[^\n|]*\|\s*(?:ba)?sh|invoke-expression|iex\s*\(|DownloadString"
LIFECYCLE = r"(?i)^(?:pre|post)?(?:install|prepare|publish)$"
PLAIN_GIT = r"(?i)^git\+http://"
SECTIONS = ["dependencies", "devDependencies", "optionalDependencies"]


def line_of(text: Column, needle: Column) -> Column:
    """The first line that holds needle; null if none does."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, needle)), True)
    return F.when(at > 0, at.cast("int"))


def entries(files, sections: list[str]):
    """repo_id, path, text, section, key, value, is_string of the objects under sections of package.json files."""
    parsed = files.withColumn("_v", F.try_parse_json("text")).where("_v is not null")
    one = lambda s: F.struct(F.lit(s).alias("section"), F.try_variant_get("_v", f"$.{s}", "map<string,variant>").alias("m"))
    rows = parsed.select("repo_id", "path", "text", F.explode(F.array(*[one(s) for s in sections])).alias("s")).select("repo_id", "path", "text", "s.section", F.explode("s.m").alias("key", "v"))
    return rows.select("repo_id", "path", "text", "section", "key", F.try_variant_get("v", "$", "string").alias("value"), (F.schema_of_variant("v") == "STRING").alias("is_string"))


def detect(tables: Tables) -> Found:
    root = tables.files.where("path = 'package.json' and issue_code is null and text is not null")
    quoted = F.concat(F.lit('"'), F.col("key"), F.lit('"'))
    line = line_of(F.col("text"), quoted)
    script = entries(root, ["scripts"]).where("is_string").where(F.col("value").rlike(REMOTE_CODE))
    scripts = findings(
        script,
        id=F.concat(F.lit(f"{ID}:script:"), F.col("key")),
        detector_id=ID,
        severity=F.when(F.col("key").rlike(LIFECYCLE), "critical").otherwise("high"),
        title=F.concat(F.lit("Script runs remote code: "), F.col("key")),
        explanation=F.concat(F.lit("The script "), F.col("key"), F.lit(" downloads and runs code, or evaluates text; an install would run it unseen.")),
        fix_prompt=F.concat(F.lit("Remove the script "), F.col("key"), F.lit(" or replace the download by a pinned dependency.")),
        file=F.col("path"),
        line=line,
        evidence=F.concat(F.col("key"), F.lit(": "), F.substring("value", 1, 80)),
        metadata=F.to_json(F.struct(F.col("key").alias("script"))),
    )
    plain = entries(root, SECTIONS).where("is_string").where(F.col("value").rlike(PLAIN_GIT))
    git = findings(
        plain,
        id=F.concat(F.lit(f"{ID}:git-http:"), F.col("key")),
        detector_id=ID,
        severity="high",
        title=F.concat(F.lit("Dependency fetched over plain HTTP: "), F.col("key")),
        explanation=F.concat(F.col("key"), F.lit(" comes from a git repository over http://; anyone on the way can change it.")),
        fix_prompt=F.concat(F.lit("Fetch "), F.col("key"), F.lit(" over git+https:// or from the registry.")),
        file=F.col("path"),
        line=line,
        evidence=F.concat(F.col("key"), F.lit(": "), F.col("value")),
        metadata=F.to_json(F.struct(F.col("key").alias("package"), F.col("value").alias("version"))),
    )
    return Found(scripts.unionByName(git), analysed=root.select("repo_id", "path"))
