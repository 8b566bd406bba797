"""Arithmetic with fixed null, NaN and zero rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, digits: int | None = None) -> Column:
    """``num / den``; null when the denominator is 0 (ANSI mode would raise)."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if digits is None else F.round(out, digits)


def ratio_or_zero(num: Column | str, den: Column | str, factor: float = 1.0,
                  digits: int | None = None) -> Column:
    """``num / den * factor``; 0 unless the denominator is positive."""
    quotient = ratio(num, den) * F.lit(factor)
    if digits is not None:
        quotient = F.round(quotient, digits)
    return F.when(col(den) > 0, quotient).otherwise(F.lit(0.0))


def present(c: Column | str) -> Column:
    """True for values that are neither null nor NaN."""
    value = col(c)
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null for a constant column or fewer than two rows."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = present(x) & present(y)
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def min_max(value: Column, lo: Column, hi: Column, epsilon: float = 0.0) -> Column:
    """Rescale to [0, 1]; with ``epsilon`` 0 a constant column stays as it is."""
    if epsilon:
        return (value - lo) / (hi - lo + F.lit(epsilon))
    return F.when(hi > lo, F.try_divide(value - lo, hi - lo)).otherwise(value)
