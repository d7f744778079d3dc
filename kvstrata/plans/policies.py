"""Compaction policies: which files to merge next.

Inputs are file statistics (one row or object for each file), so these are plans over a
catalog, not over data; sums and triggers also come as DataFrame queries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.schema import LeveledStrategy, TieredStrategy


@dataclass(frozen=True)
class File:
    index: int
    level: int
    size: int = 0
    min_key: bytes = b""
    max_key: bytes = b""
    min_tsn: int = 0
    max_tsn: int = 0
    head: int = 0
    total: int = 0

    @property
    def head_ratio(self) -> float:
        return self.head / self.total if self.total else 1.0


@dataclass(frozen=True)
class Merge:
    files: frozenset[int]
    output: int
    keep_tombstones: bool
    trigger: str


TRIGGERS = ("TIER_SPACE_AMPLIFICATION", "TIER_SIZE_RATIO", "TIER_HEIGHT_REDUCTION", "LEVELED_LEVEL0", "LEVELED_TARGET_SIZE_RATIO", "FULL_COMPACTION")


def target_sizes(real: Sequence[int], levels: int, base: int, multiplier: float) -> list[int]:
    """Target bytes of each level: the last has its real size, or the base if that is more;
    each level above a share of the next, down to the first below the base."""
    out = [0] * levels
    size = max(base, real[-1] if real else 0)
    for level in range(levels - 1, -1, -1):
        out[level] = int(size)
        if size < base:
            break
        size = size / multiplier
    return out


def size_ratios(real: Sequence[int], target: Sequence[int]) -> list[float]:
    """Real over target size, where that is above 1, else 0."""
    return [r / t if t > 0 and r / t > 1.0 else 0.0 for r, t in zip(real, target, strict=True)]


def worst_level(ratios: Sequence[float]) -> int | None:
    """The first level with the greatest ratio; None if all are 0."""
    best = max(ratios, default=0.0)
    return list(ratios).index(best) if best > 0 else None


def pick(files: Sequence[File], selection: str) -> File | None:
    """The file to move down: with most deletions (least share of heads), or the oldest
    smallest, or the oldest largest version."""
    order = {
        "BY_MOST_DELETIONS": lambda f: (f.head_ratio, f.min_tsn, f.index),
        "OLDEST_SMALLEST_SEQUENCE_FIRST": lambda f: (f.min_tsn, f.index),
        "OLDEST_LARGEST_SEQUENCE_FIRST": lambda f: (f.max_tsn, f.index),
    }[selection]
    return min(files, key=order, default=None)


def _meeting(files: Sequence[File], picked: Sequence[File]) -> list[File]:
    lo, hi = min(f.min_key for f in picked), max(f.max_key for f in picked)
    return [f for f in files if f.min_key <= hi and lo <= f.max_key]


def leveled(files: Sequence[File], s: LeveledStrategy) -> Merge | None:
    """The next merge of a leveled store: of all of level 0 once it has enough files, else
    of one file of the level that exceeds its target most."""
    by = [[f for f in files if f.level == k] for k in range(s.max_levels)]
    sizes = [sum(f.size for f in x) for x in by]
    targets = target_sizes(sizes, s.max_levels, s.base_bytes, s.level_size_multiplier)
    if len(by[0]) >= s.level0_trigger:
        upper = [k for k in range(1, s.max_levels) if by[k]]
        goal = next((k for k in range(1, s.max_levels) if targets[k] > 0), s.max_levels - 1)
        merged = [*by[0], *_meeting(by[goal], by[0])]
        return Merge(frozenset(f.index for f in merged), goal, bool(upper), "LEVELED_LEVEL0")
    level = worst_level([0.0, *size_ratios(sizes, targets)[1:-1], 0.0])
    if level is None:
        return None
    chosen = pick(by[level], s.file_selection)
    goal = level + 1
    merged = [chosen, *_meeting(by[goal], [chosen])]
    return Merge(frozenset(f.index for f in merged), goal, goal < max(f.level for f in files), "LEVELED_TARGET_SIZE_RATIO")


def tiered(files: Sequence[File], s: TieredStrategy) -> Merge | None:
    """The next merge of a tiered store: of all files if the lower tiers outweigh the last,
    else of the tiers up to one that outweighs those below it, else of enough tiers to
    keep their number."""
    levels = sorted({f.level for f in files})
    tier0 = sum(f.level == 0 for f in files)
    if not levels or len(levels) - 1 + tier0 < s.number_of_tiers:
        return None
    top = levels[-1]
    size = {k: sum(f.size for f in files if f.level == k) for k in levels}

    def merge(chosen: list[int], trigger: str) -> Merge:
        out = chosen[-1]
        return Merge(frozenset(f.index for f in files if f.level in chosen), out, out < top, trigger)

    if len(levels) > 1 and size[top] and sum(size[k] for k in levels[:-1]) / size[top] >= s.max_space_amplification:
        return merge(levels, "TIER_SPACE_AMPLIFICATION")
    below = 0
    for i, k in enumerate(levels):
        if i and below and size[k] / below > s.size_ratio and i + 1 >= s.min_merge_tiers:
            return merge(levels[: i + 1], "TIER_SIZE_RATIO")
        below += size[k]
    count = min(len(levels), max(len(levels) - s.number_of_tiers + 2, 2))
    return merge(levels[:count], "TIER_HEIGHT_REDUCTION") if len(levels) >= 2 or tier0 > 1 else None


def full(files: Sequence[File]) -> Merge | None:
    """A merge of everything; none if only one level or tier holds files already merged."""
    levels = {f.level for f in files}
    if not files or (len(levels) == 1 and levels != {0}):
        return None
    return Merge(frozenset(f.index for f in files), max(levels), False, "FULL_COMPACTION")


def level_sizes(files: DataFrame) -> DataFrame:
    """By store and level (or tier): bytes and files."""
    return files.groupBy("store_id", "level_or_tier").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("files"))


def tier_triggers(files: DataFrame, s: TieredStrategy) -> DataFrame:
    """By store: non-empty tiers, files of tier 0, whether the gate is open, the space
    amplification, and the first tier that exceeds the size ratio."""
    tiers = level_sizes(files)
    below = F.sum("size_bytes").over(Window.partitionBy("store_id").orderBy("level_or_tier").rowsBetween(Window.unboundedPreceding, -1))
    number = F.row_number().over(Window.partitionBy("store_id").orderBy("level_or_tier"))
    rows = tiers.withColumns({"below": below, "number": number})
    over = (F.col("size_bytes") / F.col("below") > s.size_ratio) & (F.col("number") >= s.min_merge_tiers)
    out = rows.groupBy("store_id").agg(F.count("*").alias("tiers"), F.sum(F.when(F.col("level_or_tier") == 0, F.col("files")).otherwise(0)).alias("tier0_files"), F.sum("size_bytes").alias("total"), F.max_by("size_bytes", "level_or_tier").alias("last"), F.min(F.when(over, F.col("level_or_tier"))).alias("size_ratio_tier"))
    return out.select("store_id", "tiers", "tier0_files", (F.col("tiers") - 1 + F.col("tier0_files") >= s.number_of_tiers).alias("gate_open"), ((F.col("total") - F.col("last")) / F.col("last")).alias("space_amplification"), "size_ratio_tier")
