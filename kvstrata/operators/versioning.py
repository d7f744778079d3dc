"""The relational core: what a change log looks like at a version, and layers over it.

All functions take and return DataFrames with the columns of ``commands`` (or, for layers,
any key columns and a value). The latest version of a key is found by an aggregate that is
combined before the shuffle (``max_by``), so a key with a third of all versions sends one row
for each task. Where it matters which version follows which (time travel, dropping history),
a window sorts the versions of each key, which spills but lies in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.functions.ranges import range_of

KEY = ["store_id", "key"]


def latest(commands: DataFrame, tsn: int | None = None) -> DataFrame:
    """The last command of each key at a version, deletions included."""
    seen = commands if tsn is None else commands.where(F.col("tsn") <= tsn)
    rest = [c for c in commands.columns if c not in KEY]
    best = seen.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "tsn").alias("r"))
    return best.select(*[F.col(c) if c in KEY else F.col(f"r.{c}").alias(c) for c in commands.columns])


def drop_tombstones(commands: DataFrame) -> DataFrame:
    return commands.where(F.col("op") == "PUT")


def as_of(commands: DataFrame, tsn: int | None = None, include_deletions: bool = False) -> DataFrame:
    """The visible state at a version. Deletions are hidden after, never before, the last
    version is chosen."""
    out = latest(commands, tsn)
    return out if include_deletions else drop_tombstones(out)


def time_travel(commands: DataFrame, snapshots: DataFrame, block: int = 1000) -> DataFrame:
    """Visible rows at each of many versions (column ``snapshot``).

    One pass finds for each command the version that ends it, and the asked snapshots that
    see it: a slice of their sorted list, found by binary search. The list, which somebody
    asked for, is taken in blocks of ``block``; the result has a row for each key and
    snapshot, so blocks cost nothing beyond it."""
    ends = F.lead("tsn").over(Window.partitionBy(*KEY).orderBy("tsn"))
    spans = commands.withColumn("__end", ends).where(F.col("op") == "PUT")
    out, asked = None, snapshots.where("snapshot IS NOT NULL").select("snapshot").distinct().orderBy("snapshot").toLocalIterator()
    while cuts := [r[0] for r in islice(asked, block)]:
        first = range_of(F.col("tsn") - 1, cuts)
        last = F.when(F.col("__end").isNull(), len(cuts)).otherwise(range_of(F.col("__end") - 1, cuts))
        table = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        seen = spans.withColumn("snapshot", F.explode(F.slice(table, first + 1, last - first)))
        out = seen if out is None else out.unionByName(seen)
    return (spans.withColumn("snapshot", F.lit(None).cast("bigint")).where("false") if out is None else out).drop("__end")


def overlay(layers: list[DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """Layers from low to high priority: for each key the highest layer that has it wins, and
    a null there deletes it."""
    named = [x.select(*keys, F.lit(i).alias("__p"), F.col(value)) for i, x in enumerate(layers)]
    best = reduce(DataFrame.unionByName, named).groupBy(*keys).agg(F.max_by(F.struct(F.col(value)), "__p").alias("v"))
    return best.select(*keys, F.col(f"v.{value}").alias(value)).where(F.col(value).isNotNull())


def overlay_onto(top: DataFrame, base: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return overlay([base, top], keys, value)


def overlay_under(base: DataFrame, top: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return overlay([base, top], keys, value)


def check_ordered(rows: DataFrame, by: list[str], strict: bool = True, within: list[str] | None = None) -> DataFrame:
    """``rows`` unchanged; running them fails if, in the order of ``within`` and ``__pos``,
    ``by`` ever falls (strict: or repeats). Rows need a column ``__pos``; each partition
    key of ``within`` is checked on its own."""
    w = Window.partitionBy(*(within or [])).orderBy("__pos")
    before, now = F.lag(F.struct(*by)).over(w), F.struct(*by)
    ok = before.isNull() | (before < now if strict else before <= now)
    return rows.withColumn("__ok", ok).where(F.when(F.col("__ok"), True).otherwise(F.raise_error(F.lit("rows are out of order")).cast("boolean"))).drop("__ok", "__pos")


def distinct_commands(commands: DataFrame) -> DataFrame:
    """Repeated commands once."""
    return commands.dropDuplicates([*KEY, "tsn", "op", "value"])


def _next_tsn() -> Column:
    return F.lead("tsn").over(Window.partitionBy(*KEY).orderBy("tsn"))


def drop_history(commands: DataFrame, tsn: int) -> DataFrame:
    """Drops a version below ``tsn`` if its key has any newer one."""
    return commands.withColumn("__n", _next_tsn()).where(F.col("__n").isNull() | (F.col("tsn") >= tsn)).drop("__n")


def drop_history_safe(commands: DataFrame, tsn: int) -> DataFrame:
    """Drops a version only if the next one is visible at ``tsn`` too, so a reader at
    ``tsn`` or later loses nothing."""
    return commands.withColumn("__n", _next_tsn()).where(F.col("__n").isNull() | (F.col("__n") > tsn)).drop("__n")


def map_value(rows: DataFrame, f: Callable[[Column], Column], value: str = "value") -> DataFrame:
    return rows.withColumn(value, f(F.col(value)))


def map_key(rows: DataFrame, f: Callable[[Column], Column], key: str = "key") -> DataFrame:
    """Callers keep the order of keys; ``f``'s inverse is for seeks, on the rows before."""
    return rows.withColumn(key, f(F.col(key)))


def map_key_and_value(rows: DataFrame, f: Callable[[Column], Column], g: Callable[[Column], Column], key: str = "key", value: str = "value") -> DataFrame:
    return rows.withColumns({key: f(F.col(key)), value: g(F.col(value))})


def filter_keys(rows: DataFrame, test: Callable[[Column], Column], key: str = "key") -> DataFrame:
    return rows.where(test(F.col(key)))


def filter_values(rows: DataFrame, test: Callable[[Column], Column], value: str = "value") -> DataFrame:
    return rows.where(test(F.col(value)))
