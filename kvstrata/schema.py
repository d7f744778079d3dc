"""Relations of the engine, store names, sizes and settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import total_ordering

COMMANDS = "store_id string, key binary, tsn bigint, op string, value binary"
FILES = "store_id string, file_index bigint, level_or_tier int, size_bytes bigint, min_key binary, max_key binary, min_tsn bigint, max_tsn bigint, total_entries bigint, head_entries bigint, number_of_merges int, max_completely_written_tsn bigint"
WAL = "seq bigint, type string, commit_tsn bigint, store_id string, key binary, op string, value binary"

_SEGMENT = re.compile(r"[a-z0-9_-]+")
_DEVICES = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(10))}


@total_ordering
@dataclass(frozen=True)
class StoreId:
    """Path of a store: lower-case segments, joined by slashes."""

    path: str

    def __post_init__(self):
        for part in self.segments:
            if not _SEGMENT.fullmatch(part) or part in _DEVICES:
                raise ValueError(f"invalid store id: {self.path!r}")

    @property
    def segments(self) -> list[str]:
        return self.path.split("/")

    @property
    def is_system(self) -> bool:
        return self.path.startswith("_")

    def nests_with(self, other: StoreId) -> bool:
        """Whether one is the other, or a folder of it."""
        a, b = self.segments, other.segments
        n = min(len(a), len(b))
        return a[:n] == b[:n]

    def __lt__(self, other: StoreId) -> bool:
        return self.path < other.path

    def __str__(self) -> str:
        return self.path


UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40, "PiB": 1 << 50}


@total_ordering
@dataclass(frozen=True)
class BinarySize:
    """A number of bytes, with arithmetic."""

    bytes: int

    def __post_init__(self):
        if self.bytes < 0:
            raise ValueError("a size can't be negative")

    @classmethod
    def of(cls, value: float, unit: str = "B") -> BinarySize:
        return cls(int(value * UNITS[unit]))

    @classmethod
    def parse(cls, text: str) -> BinarySize:
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGTP]iB|B)\s*", text)
        if not m:
            raise ValueError(f"not a size: {text!r}")
        return cls.of(float(m[1]), m[2])

    def __add__(self, other: BinarySize) -> BinarySize:
        return BinarySize(self.bytes + other.bytes)

    def __sub__(self, other: BinarySize) -> BinarySize:
        return BinarySize(self.bytes - other.bytes)

    def __mul__(self, factor: float) -> BinarySize:
        return BinarySize(int(self.bytes * factor))

    def __truediv__(self, factor: float) -> BinarySize:
        return BinarySize(int(self.bytes / factor))

    def __lt__(self, other: BinarySize) -> bool:
        return self.bytes < other.bytes

    def __str__(self) -> str:
        unit = max((u for u in UNITS if UNITS[u] <= max(self.bytes, 1)), key=UNITS.get)
        return f"{self.bytes / UNITS[unit]:.2f} {unit}" if unit != "B" else f"{self.bytes} B"

    @staticmethod
    def sum(sizes) -> BinarySize:
        return BinarySize(sum(s.bytes for s in sizes))


@dataclass(frozen=True)
class LeveledStrategy:
    level_size_multiplier: float = 10.0
    level0_trigger: int = 5
    max_levels: int = 8
    base_bytes: int = 200 << 20
    file_selection: str = "BY_MOST_DELETIONS"
    target_file_bytes: int | None = 512 << 20

    kind = "leveled"


@dataclass(frozen=True)
class TieredStrategy:
    number_of_tiers: int = 8
    max_space_amplification: float = 2.0
    size_ratio: float = 1.0
    min_merge_tiers: int = 2
    target_file_bytes: int | None = 512 << 20

    kind = "tiered"


@dataclass(frozen=True)
class Settings:
    """Settings of an engine. What only tuned threads, caches or file drivers elsewhere is
    up to Spark here."""

    compression: str = "gzip"
    default_strategy: LeveledStrategy | TieredStrategy = field(default_factory=LeveledStrategy)
    max_block_bytes: int = 8 << 20
    lock_timeout_s: float = 10.0
    checkpoint_operations: int = 1000
    statistics: bool = False
    maintenance_threads: int = 4
    minor_compaction_cron: str | None = "0 */10 * * * *"
    major_compaction_cron: str | None = "0 0 2 * * 0"
    checkpoint_cron: str | None = "0 */10 * * * *"
    garbage_cron: str | None = "0 */10 * * * *"
    flush_bytes: int | None = None  # unflushed bytes from which a commit flushes; None: never
    checkpoint_on_close: bool = False
    manifest_log: str = "auto"  # "file": one local file under a lock; "objects": a file a line
    orphan_age_s: float = 86_400.0  # with "objects", files that no line names go when as old as this

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)
