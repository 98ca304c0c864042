"""Exact number expressions for shares and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_tenth(value: Column) -> Column:
    """A non-negative double rounded to the nearest tenth of its exact binary value, ties to even.

    ``round`` and ``bround`` look at the shortest decimal text instead and so
    differ on values such as 0.35.  The distance to the half-way point is
    computed without rounding error: the fraction and its products with powers
    of two are exact, and each difference is between close numbers.
    """
    whole = F.floor(value).cast("double")
    fraction = value - whole
    tenths = F.floor(fraction * 10).cast("double")
    middle = tenths * 2 + 1
    past = (fraction * 16 - middle) + fraction * 4
    up = (past > 0) | ((past == 0) & (tenths % 2 == 1))
    return (whole * 10 + tenths + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(10.0)


def percent(count: Column, total: Column) -> Column:
    """count as a percentage of total to one decimal; an empty total counts as one."""
    base = F.when(total == 0, F.lit(1)).otherwise(F.coalesce(total, F.lit(1))).cast("double")
    return round_tenth(count.cast("double") / base * F.lit(100.0))


def fixed_tenth(amount: Column, unit: int) -> Column:
    """Text of amount / unit with one decimal, ties up; both are whole numbers."""
    tenths = F.floor((amount * 20 + unit) / F.lit(2 * unit))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
