"""Arithmetic that keeps missing apart from zero, whatever the ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """NaN and infinities to NULL, so that aggregates skip them."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, missing when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def pearson(x: str | Column, y: str | Column, where: Column | None = None, min_n: int = 2) -> Column:
    """Aggregate: Pearson r over complete pairs; missing without spread or rows."""
    ok = both(col(x), col(y)) if where is None else both(col(x), col(y)) & where
    a, b = F.when(ok, col(x).cast("double")), F.when(ok, col(y).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count_if(ok) >= min_n, r)


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Round for reporting; never returns a negative zero."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(x, digits))


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail 2*(1-Phi(|z|)) by the Chebyshev fit of erfc.

    Fixed values: the published rational-exponent coefficients, relative error
    below 1.2e-7 everywhere.
    """
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    return F.least(t * F.exp(-x * x + poly), F.lit(1.0))
