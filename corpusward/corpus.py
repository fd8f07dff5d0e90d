"""Scans of many repositories, some at a time, that go on where they stopped.

A batch's findings are written first, its repositories' rows last: a batch counts when these are
there, so what a stopped run left half done is no part of the result and is done again. A batch that
fails is halved until what fails stands alone; that repository becomes a row which says why."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.operators.references import first_by
from corpusward.scan import Result, scan_folders
from corpusward.schemas import FINDING
from corpusward.sinks import reports

REPO = "repo_id string, batch string, status string, error string, trust_score long, issues long, scanned_at timestamp"
SCANNED, FAILED = "scanned", "failed"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def repo_rows(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each repository that was tried (REPO)."""
    rows = _table(spark, f"{out}/repos", REPO)
    return first_by(rows, ["repo_id"], [-F.unix_micros("scanned_at"), F.col("batch")])


def found_rows(spark: SparkSession, out: str) -> DataFrame:
    """The findings of repositories that were scanned, each from its last batch."""
    rows = _table(spark, f"{out}/findings", f"{FINDING}, batch string")
    return rows.join(repo_rows(spark, out).where(F.col("status") == SCANNED).select("repo_id", "batch"), ["repo_id", "batch"], "left_semi")


def run_corpus(spark: SparkSession, folders: dict[str, str], out: str, batch: int = 200, scan: Callable[[SparkSession, dict[str, str]], Result] = scan_folders) -> DataFrame:
    """repo_rows after a scan of the repositories (ids and folders) that out has no row of, or only one
    of a failure. out: a folder that the driver and all executors see. scan: what scans a batch."""
    done = repo_rows(spark, out).where(F.col("status") == SCANNED).select("repo_id")
    given = spark.createDataFrame(list(folders.items()), "repo_id string, root string")
    left = sorted(tuple(r) for r in given.join(done, "repo_id", "left_anti").collect())

    def one(some: list[tuple[str, str]]) -> None:
        number, result = uuid.uuid4().hex, None
        try:
            result = scan(spark, dict(some))
            result.findings.withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(f"{out}/findings")
            closed = result.issues.where(F.col("code").endswith("-walk-directory-failed") & (F.col("file") == ".")).groupBy("repo_id").agg(F.min("message").alias("error"))
            rows = result.summary().select("repo_id", "trust_score", "issues").join(closed, "repo_id", "left")
            status = F.when(F.col("error").isNull(), SCANNED).otherwise(FAILED)
            rows.select("repo_id", F.lit(number).alias("batch"), status.alias("status"), "error", F.col("trust_score").cast("long"), F.col("issues").cast("long"), F.current_timestamp().alias("scanned_at")).write.mode("append").parquet(f"{out}/repos")
        except (PySparkException, Py4JError, OSError, ValueError) as error:
            if len(some) > 1:
                half = len(some) // 2
                one(some[:half])
                one(some[half:])
                return
            failed = spark.createDataFrame([(some[0][0], number, FAILED, str(error)[:500], None, None)], REPO.rpartition(",")[0])
            failed.withColumn("scanned_at", F.current_timestamp()).write.mode("append").parquet(f"{out}/repos")
        finally:
            if result is not None:
                result.release()

    for low in range(0, len(left), batch):
        one(left[low : low + batch])
    return repo_rows(spark, out)


def corpus_report(spark: SparkSession, out: str) -> DataFrame:
    """status, scanned (repositories), affected, rate, ghosts, in_docs over all that was tried."""
    return reports.corpus_counts(repo_rows(spark, out).select("repo_id", "status"), reports.ghosts(found_rows(spark, out)), "status")
