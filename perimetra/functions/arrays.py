"""Array columns: binding a value once, means and medians."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column named inside a lambda may be put back in as its whole expression and run per
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def middle_of(s: Column) -> Column:
    """Median of an array column already sorted."""
    n = F.size(s)
    mid = F.floor(n / F.lit(2)).cast("int")
    odd, even = F.get(s, mid), (F.get(s, mid - 1) + F.get(s, mid)) / 2.0
    return F.when(n > 0, F.when(n % 2 == 1, odd).otherwise(even))


def median_of(values: Column) -> Column:
    """Median of an array column."""
    return let(F.sort_array(values), middle_of)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def share_of(flags: Column) -> Column:
    """Share of true elements."""
    return F.size(F.filter(flags, lambda v: v)) / F.nullif(F.size(flags), F.lit(0))
