"""Findings of files as they arrive: the per-file detectors over a stream.

Detectors that pick a winner across files (package references, provenance) need all of them and
run in batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.detectors import crypto, secrets
from corpusward.schemas import Tables

FILE = "repo_id string, path string, content string"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The files table from JSON lines (repo_id, path, content) that land in a folder."""
    rows = spark.readStream.schema(FILE).json(folder)
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"^.*[^.].*?(\.[^.]*)$", 1))
    return rows.select("repo_id", "path", base.alias("basename"), ext.alias("ext"), F.col("content").alias("text"), F.lit(True).alias("in_text_walk"), F.lit(None).cast("string").alias("issue_code"))


def findings_stream(files: DataFrame) -> DataFrame:
    """Findings of the cryptography and credential-format rules, one stream."""
    tables = Tables(files, files.select("repo_id"))
    return crypto.detect(tables).findings.unionByName(secrets.detect(tables, entropy=False).findings)
