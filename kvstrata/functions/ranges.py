"""Places of values among sorted cuts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by binary search: the
    expression has one literal array and stays flat however many cuts there are."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(c) for c in cuts])
    fits = lambda at, step: (at + step <= len(cuts)) & (F.get(table, at + step - 1) <= value)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))
