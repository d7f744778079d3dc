"""Compaction of change logs, and statistics and splitting of the files that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.functions.bytesfn import command_size
from kvstrata.operators.reads import running_total
from kvstrata.operators.versioning import distinct_commands, drop_history_safe, drop_tombstones, latest


def compact(commands: DataFrame, smallest_open_tsn: int | None = None, keep_tombstones: bool = True) -> DataFrame:
    """What a merge of files keeps: each command once; without open readers only each key's
    last version, else all versions that a reader at ``smallest_open_tsn`` or later may
    see; deletions only if lower levels may hold the key."""
    once = distinct_commands(commands)
    kept = latest(once) if smallest_open_tsn is None else drop_history_safe(once, smallest_open_tsn)
    if keep_tombstones:
        return kept
    if smallest_open_tsn is None:
        return drop_tombstones(kept)
    # A deletion may go only with nothing older of its key left for it to hide.
    first = F.min("tsn").over(Window.partitionBy("store_id", "key"))
    return kept.withColumn("__first", first).where((F.col("op") == "PUT") | (F.col("tsn") > F.col("__first"))).drop("__first")


def file_stats(commands: DataFrame, file: list[str]) -> DataFrame:
    """By file: least and greatest key, first and last (key, version), least and greatest
    version, entries, head entries (keys whose last version there is a put), history
    entries, the head's share, and bytes. Two aggregates, the first by file and key."""
    size = command_size(F.col("key"), F.col("op"), F.col("value"))
    keys = commands.groupBy(*file, "key").agg(F.min("tsn").alias("lo"), F.max("tsn").alias("hi"), F.count("*").alias("n"), F.max_by("op", "tsn").alias("last"), F.sum(size).alias("bytes"))
    head = F.count_if(F.col("last") == "PUT")
    total = F.sum("n")
    out = keys.groupBy(*file).agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min_by("lo", "key").alias("first_tsn"),
        F.max_by("hi", "key").alias("last_tsn"),
        F.min("lo").alias("min_tsn"),
        F.max("hi").alias("max_tsn"),
        total.alias("total_entries"),
        head.alias("head_entries"),
        F.sum("bytes").alias("size_bytes"),
    )
    return with_ratios(out)


def with_ratios(stats: DataFrame) -> DataFrame:
    """History entries, and the head's share (1 of an empty file)."""
    return stats.withColumns({"history_entries": F.col("total_entries") - F.col("head_entries"), "head_history_ratio": F.when(F.col("total_entries") > 0, F.col("head_entries") / F.col("total_entries")).otherwise(F.lit(1.0))})


def block_stats(commands: DataFrame, file: list[str], block_bytes: int) -> DataFrame:
    """By file and block (cut where the bytes before reach another ``block_bytes``): least
    and greatest key and version, entries and bytes."""
    size = command_size(F.col("key"), F.col("op"), F.col("value")).cast("bigint")
    before = running_total(commands, size, file, ["key", "tsn"], "__before")
    blocks = before.withColumns({"size": size, "block": F.floor(F.col("__before") / block_bytes).cast("bigint")})
    return blocks.groupBy(*file, "block").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("tsn").alias("min_tsn"), F.max("tsn").alias("max_tsn"), F.count("*").alias("entries"), F.sum("size").alias("size_bytes"))


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Whether two closed key ranges meet."""
    return (a_min <= b_max) & (b_min <= a_max)


def may_contain(files: DataFrame, key: bytes, tsn: int | None = None) -> DataFrame:
    """Files that may hold a key, and data that a reader at ``tsn`` may see."""
    test = (F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key))
    return files.where(test & (F.col("min_tsn") <= tsn) if tsn is not None else test)


def overlapping_files(files: DataFrame, picked: DataFrame) -> DataFrame:
    """Files of the relation whose key ranges meet those of a picked one. File lists are
    small: thousands of rows for terabytes of data."""
    p = picked.select(F.min("min_key").over(Window.partitionBy()).alias("lo"), F.max("max_key").over(Window.partitionBy()).alias("hi")).limit(1)
    return files.join(p, overlaps(files.min_key, files.max_key, p.lo, p.hi), "left_semi")


def overlapping_pairs(a: DataFrame, b: DataFrame, bin_of: Callable[[Column], Column]) -> DataFrame:
    """Pairs (a, b) of the files of two levels whose closed key ranges meet. ``bin_of`` maps
    keys to whole numbers in their order. Each file goes to the bins that its range touches,
    and files meet in the first bin that both touch: an equi-join, without repeated pairs."""

    def binned(files: DataFrame, name: str) -> DataFrame:
        lo, hi = bin_of(F.col("min_key")).cast("bigint"), bin_of(F.col("max_key")).cast("bigint")
        return files.select(F.col("file_index").alias(name), F.col("min_key").alias(f"{name}_min"), F.col("max_key").alias(f"{name}_max"), lo.alias(f"{name}_bin"), F.explode(F.sequence(lo, hi)).alias("bin"))

    met = binned(a, "a").join(binned(b, "b"), "bin").where(F.col("bin") == F.greatest("a_bin", "b_bin"))
    return met.where(overlaps(F.col("a_min"), F.col("a_max"), F.col("b_min"), F.col("b_max"))).select("a", "b")


def split_by_floor(commands: DataFrame, target_bytes: int, file: list[str]) -> DataFrame:
    """Adds ``part``: the bytes before a row, in order, over the target. Ranges of the key
    are summed in parallel; ``split_exact`` follows the rolling rule instead."""
    size = command_size(F.col("key"), F.col("op"), F.col("value")).cast("bigint")
    before = running_total(commands, size, file, ["key", "tsn"], "__before")
    return before.withColumn("part", F.floor(F.col("__before") / target_bytes).cast("bigint")).drop("__before")


def split_exact(commands: DataFrame, target_bytes: int, file: list[str]) -> DataFrame:
    """Adds ``part`` by the rolling rule: a new file begins once the one before has reached
    the target. The rule is sequential by file; rows stream through in order, so memory
    stays bounded."""
    from pyspark.sql import types as T

    schema, names = T.StructType([*commands.schema.fields, T.StructField("part", T.LongType())]), commands.columns

    def run(batches):
        import pyarrow as pa

        last, part, size = None, 0, 0
        for b in batches:
            parts = []
            for *group, n in zip(*(b[c].to_pylist() for c in [*file, "__size"]), strict=True):
                if group != last:
                    last, part, size = group, 0, 0
                elif size >= target_bytes:
                    part, size = part + 1, 0
                parts.append(part)
                size += n
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(parts, pa.int64())], [*names, "part"])

    sized = commands.withColumn("__size", command_size(F.col("key"), F.col("op"), F.col("value")))
    return sized.repartition(*file).sortWithinPartitions(*file, "key", "tsn").mapInArrow(run, schema)
