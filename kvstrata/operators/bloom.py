"""Bloom filters of files as a relation: whether a file may hold a key, for many keys and
files at once.

A file's filter is cut into blocks of 4 KB (32,768 bits), and a key sets all its bits in one
of them. So filters are built by one aggregate that combines before its shuffle.

Files of one level are put in order of their key ranges and into groups of 2,048. A key goes
to the groups whose range holds it, as one small row for each, and meets the blocks of all
the group's files at once: their bits lie side by side, file by file for each spot, so that
one operation on a word looks up a key in 64 files. Pairs of key and file become rows only
where the filter lets the key pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS = 32_768
GROUP_FILES = 2_048
PART_KEYS = 1 << 18  # keys that meet the same blocks in one task, about
IN_RANGE = "(lo IS NULL OR key >= lo) AND (hi IS NULL OR key <= hi)"


def bloom_filters(commands: DataFrame, files: DataFrame, file: list[str], fpp: float = 0.01) -> DataFrame:
    """Blocks (file columns, level, block, bits) of the filters of ``files``, which have a
    ``total_entries`` each. A file has 2 ** level blocks, but for those that no key falls
    into. Null keys are in no filter; a file without keys has no blocks."""
    keys = commands.where("key IS NOT NULL").select(*file, "key").join(files.select(*file, _level(fpp)), file)
    spots = keys.select(*file, "level", _block().alias("block"), F.explode(F.array(*_spots(_hashes(fpp)))).alias("spot"))
    return spots.groupBy(*file, "level", "block").agg(F.bitmap_construct_agg("spot").alias("bits"))


def might_contain(filters: DataFrame, probes: DataFrame, file: list[str], fpp: float = 0.01, files: DataFrame | None = None) -> DataFrame:
    """(file columns, key) for each distinct ``key`` of ``probes`` and file that may hold it:
    all that do, and of the others a part of at most about ``fpp``. Given the ``files`` that the
    filters were built for, with their ``min_key`` and ``max_key``, keys out of a file's range
    are not looked up in it."""
    asked = probes.where("key IS NOT NULL").select("key").distinct()
    kind = asked.schema["key"].dataType
    if files is None:
        ranged = filters.select(*file, "level", F.lit(None).cast(kind).alias("lo"), F.lit(None).cast(kind).alias("hi")).distinct()
    else:
        ranged = files.select(*file, _level(fpp), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    order = Window.partitionBy("level").orderBy("lo", "hi", *file)
    grouped = ranged.withColumn("__group", F.floor((F.row_number().over(order) - 1) / GROUP_FILES))
    groups = grouped.groupBy("level", "__group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Only groups that keys fall into go on. Many keys are split, each part with a copy of the group's blocks.
    parts = F.ceil(F.count("*") / F.pow(F.lit(2.0), F.col("level")) / PART_KEYS).alias("__parts")
    groups = _met(asked, groups).groupBy("level", "__group", "lo", "hi").agg(parts)

    place = ["level", "__group", "block", "__part"]
    blocks = filters.join(grouped.select(*file, "__group", "lo", "hi"), file).join(groups.select("level", "__group", "__parts"), ["level", "__group"])
    blocks = blocks.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1)))
    keys = _met(asked, groups).withColumns({"block": _block(), "__part": F.pmod(F.xxhash64("key", F.lit(0)), F.col("__parts"))}).select(*place, "key")
    dealt = blocks.select(*place, *file, "lo", "hi", "bits").unionByName(keys, allowMissingColumns=True).repartition(*place)
    spots = [s.cast("int").alias(f"__s{i}") for i, s in enumerate(_spots(_hashes(fpp)))]
    rows = dealt.sortWithinPartitions(*place, F.col("bits").isNull()).select(*place, *file, "lo", "hi", "bits", "key", *spots)
    shape = T.StructType([rows.schema[c] for c in [*file, "lo", "hi", "key"]])
    return rows.mapInArrow(_lookup(place, [*file, "lo", "hi"], len(spots)), shape).where(IN_RANGE).select(*file, "key")


def _met(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """Each key with the groups whose ranges hold it. Groups are few: one for 2,048 files."""
    listed = groups.agg(F.collect_list(F.struct(*groups.columns)).alias("groups"))
    return asked.join(F.broadcast(listed)).select("key", F.inline("groups")).where(IN_RANGE)


def _lookup(place: list[str], file: list[str], hashes: int):
    """Over rows in the order of ``place``, blocks first, then keys: a row for each key and
    file whose bits are all set."""

    def by_spot(blocks: list[bytes]):
        """For each spot the files whose block has it set, as bits of 64-bit words."""
        import numpy as np

        out = np.zeros((BLOCK_BITS, -(-len(blocks) // 64) * 8), np.uint8)
        for i in range(0, len(blocks), 64):
            raw = np.frombuffer(b"".join(blocks[i : i + 64]), np.uint8).reshape(-1, BLOCK_BITS // 8)
            some = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
            out[:, i // 8 : i // 8 + some.shape[1]] = some
        return out.view(np.uint64)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, held, bits = None, [], None
        for b in batches:
            places = np.stack([b[c].to_numpy(zero_copy_only=False) for c in place])
            cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if start == end:
                    continue
                if at != (at := tuple(places[:, start])):
                    held, bits = [], None
                some = b.slice(start, end - start)
                blocks = len(some) - some["bits"].null_count
                if blocks:
                    held.append(some.slice(0, blocks).select([*file, "bits"]))
                some = some.slice(blocks)
                if not held or not len(some):
                    continue
                if bits is None:
                    files = pa.Table.from_batches(held).combine_chunks()
                    bits = by_spot(files["bits"].to_pylist())
                for i in range(0, len(some), 512):  # so few that all of them may be in all files
                    k = some.slice(i, 512)
                    hit = bits[k["__s0"].to_numpy()]
                    for j in range(1, hashes):
                        hit &= bits[k[f"__s{j}"].to_numpy()]
                    row, word = np.nonzero(hit)
                    n, bit = np.nonzero(np.unpackbits(hit[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    row, which = row[n], word[n] * 64 + bit
                    for j in range(0, len(row), 1 << 16):
                        found = files.take(pa.array(which[j : j + (1 << 16)])).combine_chunks()
                        yield pa.RecordBatch.from_arrays([*(found[c].chunk(0) for c in file), k["key"].take(pa.array(row[j : j + (1 << 16)]))], [*file, "key"])

    return run


def _level(fpp: float):
    bits = -math.log(fpp) / math.log(2) ** 2
    blocks = F.greatest(F.lit(1.0), F.col("total_entries") * bits * 1.05 / BLOCK_BITS)  # blocks fill unevenly
    return F.ceil(F.log2(blocks)).cast("int").alias("level")


def _hashes(fpp: float) -> int:
    return max(1, round(-math.log2(fpp)))


def _block():
    return F.pmod(F.xxhash64("key"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")))


def _spots(hashes: int) -> list:
    return [F.pmod(F.xxhash64("key", F.lit(i)), F.lit(BLOCK_BITS)).cast("bigint") for i in range(1, hashes + 1)]
