"""Point, batch, prefix and range reads, and nearest keys in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.functions.bytesfn import has_prefix
from kvstrata.functions.ranges import range_of
from kvstrata.operators.versioning import as_of, latest


def get(commands: DataFrame, store: str, key: bytes, tsn: int | None = None) -> DataFrame:
    """The visible row of one key, or none. The key filter reaches the Parquet reader."""
    return as_of(commands.where((F.col("store_id") == store) & (F.col("key") == F.lit(key))), tsn)


def get_multiple(visible: DataFrame, keys: DataFrame, on: str | list[str] = "key") -> DataFrame:
    """Visible rows of the asked keys; absent keys are left out, repeated ones collapse.
    The optimizer broadcasts the keys if they are below its size limit."""
    return visible.join(keys.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def get_with_details(commands: DataFrame, keys: DataFrame, tsn: int | None = None, transient: DataFrame | None = None) -> DataFrame:
    """For each asked (store_id, key): is_hit, is_modified_in_transaction,
    last_modification_tsn and value. A deletion is a hit without a value; so is a change
    in the transaction (``transient``: store_id, key, value), whose version is null."""
    asked = keys.select("store_id", "key").distinct()
    last = latest(commands.join(asked, ["store_id", "key"], "left_semi"), tsn).select("store_id", "key", F.col("tsn").alias("__tsn"), F.when(F.col("op") == "PUT", F.col("value")).alias("__value"))
    out = asked.join(last, ["store_id", "key"], "left")
    if transient is None:
        out = out.withColumns({"__t": F.lit(False), "__tv": F.lit(None).cast("binary")})
    else:
        out = out.join(transient.select("store_id", "key", F.lit(True).alias("__t"), F.col("value").alias("__tv")), ["store_id", "key"], "left").withColumn("__t", F.coalesce("__t", F.lit(False)))
    return out.select("store_id", "key", (F.col("__t") | F.col("__tsn").isNotNull()).alias("is_hit"), F.col("__t").alias("is_modified_in_transaction"), F.when(~F.col("__t"), F.col("__tsn")).alias("last_modification_tsn"), F.when(F.col("__t"), F.col("__tv")).otherwise(F.col("__value")).alias("value"))


def ordered(rows: DataFrame, key: str = "key", descending: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Keys, values or entries in the order of keys."""
    out = rows.orderBy(F.desc(key) if descending else F.asc(key))
    return out.select(*columns) if columns else out


def with_prefix(rows: DataFrame, prefix: bytes | str, key: str = "key") -> DataFrame:
    """Rows whose key starts with the prefix; an empty one asks for all."""
    return rows.where(has_prefix(F.col(key), prefix))


def between(rows: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Rows with low <= key <= high; None is open."""
    test = F.lit(True)
    if low is not None:
        test &= F.col(key) >= F.lit(low)
    if high is not None:
        test &= F.col(key) <= F.lit(high)
    return rows.where(test)


def first_entry(rows: DataFrame, key: str = "key") -> DataFrame:
    """The row with the least key, by an aggregate: one small row from each task."""
    return _end(rows, F.min, key)


def last_entry(rows: DataFrame, key: str = "key") -> DataFrame:
    return _end(rows, F.max, key)


def _end(rows: DataFrame, best, key: str) -> DataFrame:
    order = [key, *(c for c in rows.columns if c != key)]
    return rows.agg(best(F.struct(*order)).alias("r")).where("r IS NOT NULL").select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])


#: mode -> (test of a key against a probe, whether the least such key is asked for)
SEEKS = {"ceiling": (lambda k, p: k >= p, True), "higher": (lambda k, p: k > p, True), "floor": (lambda k, p: k <= p, False), "lower": (lambda k, p: k < p, False)}


def seek(rows: DataFrame, probe, mode: str, key: str = "key") -> DataFrame:
    """The nearest row to one probe: exact or next (ceiling), exact or previous (floor),
    strictly next (higher) or previous (lower)."""
    test, least = SEEKS[mode]
    found = rows.where(test(F.col(key), F.lit(probe)))
    return first_entry(found, key) if least else last_entry(found, key)


def range_cuts(keys: DataFrame, n: int) -> list:
    """Up to ``n`` - 1 values of the one column that cut the rows about evenly, from a bounded
    sample."""
    k = keys.columns[0]
    sample = [r[0] for r in keys.where(F.col(k).isNotNull()).orderBy(F.xxhash64(k)).limit(64 * n).orderBy(k).collect()]
    step = max(1, len(sample) // n)
    return sorted(set(sample[step::step][: n - 1]))


def ranges_wanted(rows: DataFrame, parts: int | None) -> int:
    return parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _same_range(a: Column, b: Column) -> Column:
    """Equal numbers of ranges. They are never null, but a plain equality would let the optimizer
    put the expression behind one number in the place of the other, on a side of the join
    that lacks the key it reads."""
    return a.eqNullSafe(b)


def seek_many(rows: DataFrame, probes: DataFrame, mode: str, key: str = "key", probe: str = "probe", parts: int | None = None) -> DataFrame:
    """For each probe the nearest key (null if there is none), as one merge of both sides.

    Rows are dealt to ranges of the key with probes among them; within a range a running
    maximum (or minimum) carries the last key along. What a range takes from its
    neighbours is one key each, found by a window over one row a range, so no range
    waits for another and nothing is sorted in one task."""
    _, least = SEEKS[mode]
    kind = rows.schema[key].dataType.simpleString()
    keys = rows.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    asked = probes.select(F.col(probe).cast(kind).alias("p")).where(F.col("p").isNotNull()).distinct()
    # Among equal values, keys come on the side from which an exact probe may see them.
    side = {"ceiling": 1, "floor": 0, "higher": 0, "lower": 1}[mode]
    both = keys.select(F.col("k").alias("x"), F.col("k"), F.lit(side).alias("s")).unionByName(asked.select(F.col("p").alias("x"), F.lit(None).cast(kind).alias("k"), F.lit(1 - side).alias("s")))
    both = both.withColumn("b", range_of(F.col("x"), range_cuts(keys, ranges_wanted(rows, parts))))
    order = [F.asc("x"), F.asc("s")] if not least else [F.desc("x"), F.desc("s")]
    w = Window.partitionBy("b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.min if least else F.max
    local = both.withColumn("near", pick("k").over(w)).where(F.col("k").isNull()).select("x", "b", "near")
    edges = both.groupBy("b").agg(pick("k").alias("e"))
    outward = Window.orderBy(F.desc("b") if least else F.asc("b")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = edges.select(F.col("b").alias("eb"), pick("e").over(outward).alias("beyond"))
    return local.join(beyond, _same_range(F.col("b"), F.col("eb")), "left").select(F.col("x").alias(probe), F.coalesce("near", "beyond").alias("found"))


def neighbours(rows: DataFrame, key: str = "key", within: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Each row with the keys before and after it (``previous_key``, ``next_key``), in the
    whole of each group of ``within``. Rows are dealt to ranges of the key, so a large group
    is sorted by many tasks; of each group and range, the first and last key make up for
    what its neighbours lack. Null keys come first."""
    group = within or []
    names = [f"__g{i}" for i in range(len(group))]
    cut = rows.withColumn("__b", F.coalesce(range_of(F.col(key), range_cuts(rows.select(key), ranges_wanted(rows, parts))), F.lit(0)))
    w = Window.partitionBy(*group, "__b").orderBy(key)
    local = cut.withColumns({"__p": F.lag(key).over(w), "__n": F.lead(key).over(w), "__i": F.row_number().over(w), "__e": F.lead(F.lit(1)).over(w).isNull()})
    edges = cut.groupBy(*group, "__b").agg(F.min(F.struct(key)).alias("lo"), F.max(F.struct(key)).alias("hi"))
    order = Window.partitionBy(*group).orderBy("__b")
    edges = edges.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], F.col("__b").alias("__eb"), F.lag("hi").over(order)[key].alias("__before"), F.lead("lo").over(order)[key].alias("__after"))
    same = _same_range(F.col("__b"), F.col("__eb"))
    for c, n in zip(group, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    out = local.join(edges, same, "left")
    return out.select(*rows.columns, F.when(F.col("__i") == 1, F.col("__before")).otherwise(F.col("__p")).alias("previous_key"), F.when(F.col("__e"), F.col("__after")).otherwise(F.col("__n")).alias("next_key"))


def running_total(rows: DataFrame, amount: Column, group: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows before each one, in the order of
    ``order`` within its group (rows with equal order in any order). Each range of the
    first order column is summed in a task of its own, and takes the total of the ranges
    before it from a window over one row for each group and range."""
    names = [f"__g{i}" for i in range(len(group))]
    cut = rows.withColumns({"__a": amount, "__b": F.coalesce(range_of(F.col(order[0]), range_cuts(rows.select(order[0]), ranges_wanted(rows, parts))), F.lit(0))})
    w = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.coalesce(F.sum("__a").over(w), F.lit(0)))
    sums = cut.groupBy(*group, "__b").agg(F.sum("__a").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], F.col("__b").alias("__eb"), before.alias("__before"))
    same = _same_range(F.col("__b"), F.col("__eb"))
    for c, n in zip(group, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    return local.join(sums, same, "left").select(*rows.columns, (F.col("__local") + F.col("__before")).alias(name))


def entries_from(rows: DataFrame, current, ascending: bool = True, include_current: bool = True, key: str = "key") -> DataFrame:
    """All rows from a position on, in order; none if the position is invalid (None)."""
    if current is None:
        return rows.limit(0)
    k, c = F.col(key), F.lit(current)
    test = (k >= c if ascending else k <= c) if include_current else (k > c if ascending else k < c)
    return ordered(rows.where(test), key, not ascending)


def column_of(rows: DataFrame, column: str | Column) -> DataFrame:
    return rows.select(column)
