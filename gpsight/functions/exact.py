"""Sums of doubles that don't depend on the order of the rows.

A floating sum rounds after every addition, so its last digits change with the number of
partitions and the order in which they are merged. Here each value is split, without loss, into
whole multiples of 2 ** -20 and of 2 ** -80; both parts are added up as whole numbers (decimals),
which is exact, and turned into a double once at the end. What lies below 2 ** -80 of a value is
cut off, the same way wherever the row is.

Values of 2 ** 42 or more, infinities and NaN are added up as doubles beside that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = float(2 ** 42)
UPPER, LOWER = float(2 ** 20), float(2 ** 80)
# A whole number is turned into a double in two parts, each of which fits a long.
HALF = 2 ** 31


def _as_double(total: Column, unit: float) -> Column:
    high = F.floor(total / F.lit(HALF).cast("decimal(10,0)"))
    low = total - high * F.lit(HALF).cast("decimal(10,0)")
    return high.cast("double") * F.lit(HALF / unit) + low.cast("double") * F.lit(1 / unit)


def exact_sum(x: Column | str) -> Column:
    """``sum`` of doubles, the same for every order of the rows; NULLs are skipped."""
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    small = F.abs(v) < F.lit(LIMIT)
    upper = F.when(small, F.floor(v * F.lit(UPPER)))
    rest = v - upper.cast("double") / F.lit(UPPER)
    lower = F.floor(rest * F.lit(LOWER))
    upper_sum, lower_sum = (F.sum(part.cast("decimal(20,0)")) for part in (upper, lower))
    # what the lower parts add up to beyond half a unit of the upper ones goes there, so that
    # the two don't cancel each other
    carry = F.floor(lower_sum / F.lit(2 ** 60).cast("decimal(20,0)") + F.lit(0.5).cast("decimal(2,1)"))
    left = lower_sum - carry * F.lit(2 ** 60).cast("decimal(20,0)")
    exact = _as_double(upper_sum + carry, UPPER) + _as_double(left, LOWER)
    others = F.sum(F.when(~small, v))
    return F.when(F.count_if(small) == 0, others).when(others.isNotNull(), exact + others).otherwise(exact)


def exact_mean(x: Column | str) -> Column:
    """``avg`` of doubles by :func:`exact_sum`; NULL without values."""
    c = F.col(x) if isinstance(x, str) else x
    return F.try_divide(exact_sum(c), F.count(c).cast("double"))
