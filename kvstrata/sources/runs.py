"""Sorted runs: Parquet files in the order of keys and versions, with their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.errors import FlushException
from kvstrata.functions.bytesfn import command_size
from kvstrata.schema import COMMANDS

CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


def write_run(commands: DataFrame, path: str, *, compression: str = "gzip", target_bytes: int | None = None, block_bytes: int = 8 << 20, bloom: bool = True, partitions: int | None = None) -> None:
    """Write a sorted run: ranges of keys to files, each sorted by key and version, so that
    row-group statistics prune reads by key. A bloom filter on the key serves point reads.
    ``target_bytes`` splits files by the rows of mean size, which is measured, that make it."""
    if compression not in CODECS:
        raise FlushException(f"unknown codec {compression}")
    ranged = commands.repartitionByRange(partitions, "store_id", "key") if partitions else commands.repartitionByRange("store_id", "key")
    out = ranged.sortWithinPartitions("store_id", "key", "tsn").write.option("compression", compression).option("parquet.block.size", block_bytes)
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.01")
    if target_bytes:
        mean = commands.agg(F.avg(command_size(F.col("key"), F.col("op"), F.col("value")))).first()[0]
        out = out.option("maxRecordsPerFile", max(1, int(target_bytes // (mean or 1))))
    out.parquet(path)


def write_parts(commands: DataFrame, path: str, parts: int, *, compression: str = "gzip", block_bytes: int = 8 << 20) -> None:
    """Write ``parts`` runs at once, one a range of keys, to ``path/part=k``. All versions of
    a key lie in one run."""
    ranged = commands.repartitionByRange(parts, "store_id", "key").withColumn("part", F.spark_partition_id())
    out = ranged.sortWithinPartitions("part", "store_id", "key", "tsn").write.partitionBy("part").option("compression", compression).option("parquet.block.size", block_bytes)
    out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.01").parquet(path)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The commands of some runs; an empty list has none."""
    return spark.read.schema(COMMANDS).parquet(*paths) if paths else empty(spark)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COMMANDS)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Commands from (store_id, key, tsn, op, value) tuples."""
    return spark.createDataFrame(rows, COMMANDS)


def codec_sizes(spark: SparkSession, commands: DataFrame, folder: str) -> dict[str, int]:
    """Bytes of a run in each codec that can be written."""
    out = {}
    for codec in CODECS:
        write_run(commands, f"{folder}/{codec}", compression=codec)
        out[codec] = spark.read.format("binaryFile").load(f"{folder}/{codec}/*.parquet").agg(F.sum("length")).first()[0] or 0
    return out
