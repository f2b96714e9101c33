"""Significance of a regression slope as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_TINY, _ENOUGH = 1e-300, 1e-15
_SHIFT = 32


def _gamma_half_step(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the series in 1 / z holds to double precision at z = a + ``_SHIFT``, steps of one lead back to a."""
    back = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0), lambda product, i: product * (a + i) / (a + i + 0.5))

    def series(u: Column) -> Column:
        terms = F.lit(1.0)
        power = F.lit(1.0)
        for factor in (-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144):
            power = power * u
            terms = terms + power * factor
        return terms

    return back * F.sqrt(a + _SHIFT) * let(1.0 / (a + _SHIFT), series)


def _away_from_zero(value: Column) -> Column:
    return F.when(F.abs(value) > _TINY, value).otherwise(_TINY)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated forwards (Lentz) as a fold over the numbers of its terms.

    It settles after about the square root of the larger parameter; behind that the fold passes its value on.
    """
    count = F.ceil(100 + 5 * F.sqrt(F.greatest(a, b))).cast("int")
    first = 1.0 / _away_from_zero(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"), F.lit(False).alias("settled"))

    def term(state: Column, factor: Column) -> Column:
        c, d = _away_from_zero(1.0 + factor / state["c"]), 1.0 / _away_from_zero(1.0 + factor * state["d"])
        value = state["value"] * c * d
        return F.struct(c.alias("c"), d.alias("d"), value.alias("value"), (F.abs(c * d - 1.0) < _ENOUGH).alias("settled"))

    def pair(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(state["settled"], state).otherwise(let(term(state, even), lambda half: term(half, odd)))

    return F.aggregate(F.transform(F.sequence(F.lit(1), count), lambda m: m.cast("double")), start, pair)["value"]


def p_value(r_squared: Column, points: Column) -> Column:
    """Two-sided p-value of a zero slope, from r squared and the number of points; NULL below three points or without r squared.

    It is the regularised incomplete beta function at 1 - r squared with parameters points / 2 - 1 and 1 / 2.
    """

    def of(row: Column) -> Column:
        a, x = row["a"], row["x"]
        front = _gamma_half_step(a) / math.sqrt(math.pi) * F.pow(x, a) * F.sqrt(row["r_squared"])
        # The fraction is for the side of the mean that x is on.
        left = x < (a + 1.0) / (a + 2.5)
        p, q = F.when(left, a).otherwise(0.5), F.when(left, F.lit(0.5)).otherwise(a)
        part = let(F.struct(p.alias("p"), q.alias("q"), F.when(left, x).otherwise(1.0 - x).alias("x")), lambda s: front * _fraction(s["p"], s["q"], s["x"]) / s["p"])
        inner = let(part, lambda value: F.when(left, value).otherwise(1.0 - value))
        return F.when(x <= 0.0, 0.0).when(x >= 1.0, 1.0).otherwise(inner)

    r_squared, points = r_squared.cast("double"), points.cast("double")
    row = F.struct((points / 2.0 - 1.0).alias("a"), (1.0 - r_squared).alias("x"), r_squared.alias("r_squared"))
    return F.when((points >= 3) & r_squared.isNotNull() & ~F.isnan(r_squared), let(row, of))
