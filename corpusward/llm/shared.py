"""The session's shared folder, and cutting of lineage there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a new local
    folder is used if all runs in one process, as in tests; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors see.")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def left_join_spread(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, total: int, least: int = 256, most_keys: int = 1000) -> DataFrame:
    """rows with the columns of table, which has one row for each key at most, by a left join that
    parts the keys that many rows share.

    sizes: key and n, how many of the `total` rows have it. A key of more than `least` rows, and of
    more than a share of 1 / most_keys of all rows, is dealt out in parts of about that many, by a
    hash of the whole row; its row of table is repeated for each. There are fewer than most_keys such
    keys, so they are broadcast. A null key joins nothing, and its rows are dealt out too."""
    block = max(least, -(-total // most_keys))
    parts = cut(sizes.where(F.col("n") > block).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / F.lit(block)).cast("int").alias("_parts")))
    if parts.isEmpty():
        return rows.join(table.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    many = F.coalesce("_parts", F.when(F.col(key).isNull(), most_keys), F.lit(1))
    dealt = rows.join(F.broadcast(parts), rows[key] == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(*[rows[c] for c in rows.columns]), many).cast("int")).drop("_hot", "_parts")
    held = table.withColumnRenamed(key, "_key").join(F.broadcast(parts), F.col("_key") == F.col("_hot"), "left").withColumn("_of", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return dealt.join(held, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")), "left").drop("_key", "_part", "_of")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; lost executors don't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
