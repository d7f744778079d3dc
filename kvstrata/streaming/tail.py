"""A change log as a stream: new commit files are picked up as they appear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.schema import COMMANDS


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Commands of a folder of Parquet commits, as a stream."""
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_stream(commands: DataFrame) -> DataFrame:
    """Each key's last command, kept up to date (output mode update or complete). State is one
    row a key, combined before the shuffle."""
    return commands.groupBy("store_id", "key").agg(F.max_by(F.struct("tsn", "op", "value"), "tsn").alias("r")).select("store_id", "key", "r.tsn", "r.op", "r.value")


def write_latest(commands: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each batch's changed keys to ``sink`` (batch, number), exactly once a number."""
    return latest_stream(commands).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def changes_per_window(commands: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Puts and deletions by store and time window, of commands with a time column; rows later
    than ``late`` are left out."""
    w = commands.withWatermark(time, late).groupBy("store_id", F.window(time, width))
    return w.agg(F.count_if(F.col("op") == "PUT").alias("puts"), F.count_if(F.col("op") == "DEL").alias("deletions")).select("store_id", F.col("window.start").alias("start"), "puts", "deletions")
