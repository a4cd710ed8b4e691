"""Sums and rounded ratios in integer arithmetic.

A sum of doubles depends on the order of the rows, and a rounded percentage on
how an engine stores 100*a/b.  Both are done on long integers here: values of
few decimals are counted in ticks, and division rounds half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_div(a: Column, b: Column) -> Column:
    """Non-negative integer quotient, half up."""
    return F.call_function("div", 2 * a + b, 2 * b)


def ratio(part: Column, whole: Column, digits: int, scale: int = 1, default: float | None = 0.0) -> Column:
    """``scale * part / whole`` rounded to ``digits``, for non-negative integers.

    ``default`` stands where ``whole`` is 0.
    """
    p, w = part.cast("long"), F.greatest(whole.cast("long"), F.lit(1))
    return F.when(whole == 0, F.lit(default).cast("double")).otherwise(
        rounded_div(scale * 10**digits * p, w).cast("double") / float(10**digits)
    )


def percent(part: Column, whole: Column, digits: int, default: float | None = 0.0) -> Column:
    return ratio(part, whole, digits, 100, default)


def ticks(c: Column, places: int) -> Column:
    """A non-negative value of few decimals as a whole number of 10**-places."""
    return F.floor(c * float(10**places) + 0.5).cast("long")


def exact_sum(c: Column, places: int) -> Column:
    return F.coalesce(F.sum(ticks(c, places)), F.lit(0)).cast("double") / float(10**places)


def exact_mean(c: Column, places: int) -> Column:
    """Mean over the rows of the group."""
    return exact_sum(c, places) / F.count(F.lit(1))


def rounded_mean(c: Column, places: int, digits: int) -> Column:
    """Mean over the rows of the group, half up."""
    return ratio(F.sum(ticks(c, places)), F.count(F.lit(1)) * 10**places, digits)
