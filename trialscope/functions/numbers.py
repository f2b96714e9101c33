"""Small numeric expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """``top / bottom`` where the divisor is positive, else ``otherwise``."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))


def flag(condition: Column) -> Column:
    """1 or 0, with NULL counted as 0."""
    return F.when(condition, 1).otherwise(0)


def one_decimal(value: Column) -> Column:
    """A double with one decimal, rounded from its exact binary value, ties to the even digit.

    ``format_string`` rounds the shortest decimal text half up, so 781.25 would be 781.3 there. The remainder by 1 is
    exact, so comparing it with the ten borders settles the digit: a border that is no double is above or below its nearest one.
    """
    size = F.abs(value)
    rest = size % 1

    def reached(k: int) -> Column:
        """Whether the digit is above ``k``: a rest equal to the border's double is, if that lies above the border or on it with an odd ``k``."""
        border, double = Fraction(2 * k + 1, 20), (2 * k + 1) / 20
        return rest >= double if double > border or (double == border and k % 2) else rest > double

    tenths = sum((flag(reached(k)) for k in range(1, 10)), flag(reached(0)))
    whole = F.format_string("%.0f", size - rest + F.floor(tenths / 10))
    sign = F.when(F.format_string("%.1f", value).startswith("-"), "-").otherwise("")
    return F.when(F.isnan(rest), F.format_string("%.1f", value)).otherwise(F.concat(sign, whole, F.lit("."), (tenths % 10).cast("string")))
