"""Statistics and reports."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def store_watermarks(commands: DataFrame, files: DataFrame) -> DataFrame:
    """By store: high (last version received) and low (version up to which all is in files)."""
    high = commands.groupBy("store_id").agg(F.max("tsn").alias("high_watermark"))
    low = files.groupBy("store_id").agg(F.max("max_completely_written_tsn").alias("low_watermark"))
    return high.join(low, "store_id", "left")


def engine_watermarks(stores: DataFrame) -> DataFrame:
    return stores.agg(F.max("high_watermark").alias("high_watermark"), F.min("low_watermark").alias("low_watermark"))


def estimated_entries(files: DataFrame) -> DataFrame:
    return files.groupBy("store_id").agg(F.sum("head_entries").alias("estimated_entries"))


def structure_report(files: DataFrame) -> DataFrame:
    """By store, a sorted list of layers with their files."""
    layers = files.groupBy("store_id", "level_or_tier").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n_files"), F.sort_array(F.collect_list("file_index")).alias("files"))
    return layers.groupBy("store_id").agg(F.sum("n_files").alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.sort_array(F.collect_list(F.struct("level_or_tier", "n_files", "size_bytes", "files"))).alias("layers"))


def cursor_statistics(events: DataFrame) -> DataFrame:
    """By cursor type, from rows (cursor_type, operation, n): the eight counters and what
    follows from them."""
    ops = ["opened", "closed", "first", "last", "next", "previous", "seek_floor", "seek_ceiling"]
    out = events.groupBy("cursor_type").agg(*[F.sum(F.when(F.col("operation") == o, F.col("n")).otherwise(0)).alias(o) for o in ops])
    return out.withColumns({"jumps": F.col("first") + F.col("last"), "moves": F.col("next") + F.col("previous"), "seeks": F.col("seek_floor") + F.col("seek_ceiling")}).withColumn("operations", F.col("jumps") + F.col("moves") + F.col("seeks"))


def transaction_statistics(events: DataFrame) -> DataFrame:
    """By mode, from rows (mode, outcome)."""
    return events.groupBy("mode").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("opened", "committed", "rolled_back", "dangling")])


def cache_statistics(counts: DataFrame) -> DataFrame:
    """Adds hits and hit_rate to requests and misses."""
    return counts.withColumn("hits", F.col("requests") - F.col("misses")).withColumn("hit_rate", F.when(F.col("requests") > 0, F.col("hits") / F.col("requests")).otherwise(0.0))


def flush_throughput(flushes: DataFrame) -> DataFrame:
    """Adds bytes and entries a second to rows (bytes, entries, millis)."""
    rate = lambda c: F.when(F.col("millis") > 0, F.col(c) * 1000.0 / F.col("millis"))
    return flushes.withColumns({"bytes_per_second": rate("bytes"), "entries_per_second": rate("entries")})


PERCENTILES = (5, 25, 50, 75, 95, 99)


def descriptive(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """By group: n, min, max, sum, mean, population deviation, and percentiles by nearest
    rank, the value at place floor(n * p / 100) of the sorted ones.

    The ranks are exact: equal values are counted before the sort, so a group is as long
    as its number of distinct values."""
    w = Window.partitionBy(*by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    place = counts.withColumns({"__to": F.sum("__n").over(w.orderBy(value)), "__all": F.sum("__n").over(w)})
    at = lambda p: F.floor(F.col("__all") * p / 100)
    picks = [F.max(F.when((F.col("__to") - F.col("__n") <= at(p)) & (at(p) < F.col("__to")), F.col(value))).alias(f"p{p}") for p in PERCENTILES]
    marks = place.groupBy(*by).agg(*picks)
    basic = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    on = basic[by[0]].eqNullSafe(marks[by[0]])
    for c in by[1:]:
        on &= basic[c].eqNullSafe(marks[c])
    return basic.join(marks, on, "left").select(*[basic[c] for c in by], "n", "min", "max", "sum", "mean", "stddev", *[f"p{p}" for p in PERCENTILES])


class Collector:
    """Counters of an engine. Off by default; while off, nothing counts, and the last report
    stays."""

    def __init__(self, on: bool = False):
        self._lock, self._counts, self._on, self._last = threading.Lock(), Counter(), on, None

    def start(self) -> None:
        with self._lock:
            self._on = True

    def restart(self) -> None:
        with self._lock:
            self._counts, self._on = Counter(), True

    def stop(self) -> dict:
        with self._lock:
            self._on, self._last = False, dict(self._counts)
            return self._last

    def count(self, what: str, n: int = 1) -> None:
        if self._on:
            with self._lock:
                self._counts[what] += n

    def report(self) -> dict | None:
        with self._lock:
            return dict(self._counts) if self._on else self._last
