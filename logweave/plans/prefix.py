"""Running sums, maxima and counts that do not put a whole topic into one task.

The usual window with an unbounded frame sorts all rows of a key in one task.
Here rows are cut into ranges of their order column; ranges are summed first,
the few range totals are accumulated per key, and windows then only span one
range.  Every range is fixed by the data, so repeated tasks see the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 18


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, tuple[str, Column]],
    range_size: int = RANGE_ROWS,
    exclusive: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add running aggregates over each key in the order of an integer column.

    `values` maps a new column to ("sum" | "max" | "min", expression).  With
    `exclusive` the row itself is left out; the first row of a key then gets 0
    for sums and null otherwise.  `range_size` is the width of a range in units
    of the order column: choose it so that one range of one key fits a task.
    Rows with equal order stand by `ties`.  A null order sorts first.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    at = F.coalesce(F.floor(F.col(order) / F.lit(range_size)).cast("bigint"), F.lit(-(2**62)))
    named = df.withColumns({"__range": at, **{f"__v_{n}": e for n, (_, e) in values.items()}})
    totals = named.groupBy(*keys, "__range").agg(*(kinds[k](f"__v_{n}").alias(f"__t_{n}") for n, (k, _) in values.items()))
    over_ranges = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__range", *(kinds[k](f"__t_{n}").over(over_ranges).alias(f"__b_{n}") for n, (k, _) in values.items()))
    joined = named.alias("l").join(before.alias("r"), [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in (*keys, "__range")]).select("l.*", *(f"r.__b_{n}" for n in values))
    inside = Window.partitionBy(*keys, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    made = {}
    for n, (k, _) in values.items():
        local, base = kinds[k](f"__v_{n}").over(inside), F.col(f"__b_{n}")
        if k == "sum":
            made[n] = F.coalesce(local, F.lit(0)) + F.coalesce(base, F.lit(0))
        elif k == "max":
            made[n] = F.when(local.isNull(), base).when(base.isNull(), local).otherwise(F.greatest(local, base))
        else:
            made[n] = F.when(local.isNull(), base).when(base.isNull(), local).otherwise(F.least(local, base))
    return joined.withColumns(made).drop("__range", *(f"__v_{n}" for n in values), *(f"__b_{n}" for n in values))


def previous(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str], range_size: int = RANGE_ROWS) -> DataFrame:
    """Add the values that other columns have in the row before, by key and order: a lag over ranges.

    The order must be unique within a key.
    """
    last = F.struct(F.col(order).alias("o"), *(F.col(c).alias(n) for n, c in columns.items()))
    out = running(df, keys, order, {"__last": ("max", last)}, range_size, exclusive=True)
    return out.withColumns({n: F.col(f"__last.{n}") for n in columns}).drop("__last")
