"""Exact order statistics on array columns, for frames in which the aggregate is not available.

`let` binds a value once per row: without it the optimizer may copy an expression into a lambda that uses it, and the
lambda would compute it again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    low = F.element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1)
    high = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / F.lit(2.0))


def array_median(values: Column) -> Column:
    """Median of an array that holds no NULL; NULL if it is empty."""
    return let(F.sort_array(values), _middle)


def median_and_mad(values: Column) -> Column:
    """struct(n, med, mad) of an array that holds no NULL: median and median absolute deviation from it."""

    def both(v: Column) -> Column:
        def deviation(s: Column) -> Column:
            return F.struct(F.size(s["v"]).cast("long").alias("n"), s["m"].alias("med"), array_median(F.transform(s["v"], lambda x: F.abs(x - s["m"]))).alias("mad"))

        return let(F.struct(v.alias("v"), array_median(v).alias("m")), deviation)

    return let(values, both)


def circular_days(a: Column, b: Column, period: int = 365) -> Column:
    """Distance of two days of the year around a circle of `period` days."""
    d = F.abs(a - b)
    return F.least(d, F.lit(period) - d)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def round_scaled(x: Column, digits: int) -> Column:
    """`x` times a power of ten, rounded half away from zero, and scaled back, as DuckDB rounds; Spark's `round` reads the
    shortest decimals of `x` instead, which differs where they end in a 5."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale, 0) / scale


def sum_in_order(value: Column, order: Column) -> Column:
    """Aggregate: the sum of doubles added one by one by `order`, so its last bits do not depend on partitions.  Gathers the
    group's values, so it is for small groups; NULLs are left out, and a group of none but NULLs is NULL."""
    held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda total, e: total + e["v"]))
