"""The write-ahead log as a relation: ``seq, type, commit_tsn, store_id, key, op, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.errors import WriteAheadLogCorruptedException
from kvstrata.functions.hashes import murmur3
from kvstrata.operators.reads import neighbours, seek_many


def completed(wal: DataFrame) -> DataFrame:
    """Entries of transactions that have a commit entry; what a crash cut off is gone."""
    done = wal.where("type = 'COMMIT'").select("commit_tsn").distinct()
    return wal.join(done, "commit_tsn", "left_semi").select(wal.columns)


def replay(wal: DataFrame, low_watermarks: DataFrame) -> DataFrame:
    """Commands of completed transactions above each store's low watermark (store_id,
    low_watermark; a store without one has seen nothing)."""
    rows = completed(wal).where("type = 'COMMAND'").join(low_watermarks, "store_id", "left")
    return rows.where(F.col("low_watermark").isNull() | (F.col("commit_tsn") > F.col("low_watermark"))).select("store_id", "key", F.col("commit_tsn").alias("tsn"), "op", "value")


def transactions(wal: DataFrame) -> DataFrame:
    """By transaction: whether it started and committed, and its commands."""
    return wal.groupBy("commit_tsn").agg((F.count_if(F.col("type") == "START") > 0).alias("started"), (F.count_if(F.col("type") == "COMMIT") > 0).alias("completed"), F.count_if(F.col("type") == "COMMAND").alias("commands"))


def check_complete(wal: DataFrame, max_persisted_tsn: int) -> int | None:
    """The last committed version of the log; an error if files already hold a later one, as
    then a part of the log is gone."""
    last = wal.where("type = 'COMMIT'").agg(F.max("commit_tsn")).first()[0]
    if last is not None and last < max_persisted_tsn:
        raise WriteAheadLogCorruptedException(f"the log ends at {last}, but {max_persisted_tsn} was written to files")
    return last


def check_order(wal: DataFrame) -> None:
    """An error if the versions of commits ever go down along the log. Ranges of the log are
    compared by their ends, so nothing is sorted in one task."""
    commits = wal.where("type = 'COMMIT'").select("seq", "commit_tsn")
    before = commits.select(F.col("seq").alias("previous_key"), F.col("commit_tsn").alias("before"))
    if not neighbours(commits, "seq").join(before, "previous_key").where("before > commit_tsn").isEmpty():
        raise WriteAheadLogCorruptedException("versions of commits go down along the log")


def shorten(wal: DataFrame, low_watermark: int) -> DataFrame:
    """The log without the transactions that all stores have in files: those at or below the
    least low watermark."""
    return wal.where(F.col("commit_tsn") > low_watermark)


def gaps(files: DataFrame) -> DataFrame:
    """Sequence numbers (column ``seq``) whose predecessor is missing, with the one before
    the gap. Ends and starts of runs are found by joins, and only they are searched."""
    seqs = files.select("seq").distinct()
    starts = seqs.join(seqs.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti")
    ends = seqs.join(seqs.select((F.col("seq") - 1).alias("seq")), "seq", "left_anti")
    found = seek_many(ends, starts.withColumnRenamed("seq", "probe"), "lower", "seq")
    return found.where("found IS NOT NULL").select(F.col("probe").alias("seq"), F.col("found").alias("previous"))


CHECKSUMS = {"crc32": F.crc32, "murmur3": murmur3}


def with_checksum(wal: DataFrame, kind: str = "crc32") -> DataFrame:
    """Adds ``checksum`` of each entry's content, of one of the ``CHECKSUMS``."""
    return wal.withColumn("checksum", CHECKSUMS[kind](_content()))


def damaged(wal: DataFrame, kind: str = "crc32") -> DataFrame:
    """Entries whose ``checksum`` isn't that of their content."""
    return wal.where(F.col("checksum") != CHECKSUMS[kind](_content()))


def _content():
    part = lambda c: F.coalesce(F.hex(c), F.lit("-"))
    return F.concat_ws("|", F.col("type"), F.col("commit_tsn").cast("string"), F.coalesce("store_id", F.lit("")), part("key"), F.coalesce("op", F.lit("")), part("value")).cast("binary")


def file_checksum(wal: DataFrame, file: str) -> DataFrame:
    """By file: entries, and a checksum that doesn't depend on how rows are dealt."""
    return wal.groupBy(file).agg(F.count("*").alias("entries"), F.sum(F.crc32(F.concat(F.col("seq").cast("string"), F.lit("|"), _content().cast("string")).cast("binary"))).alias("checksum"))
