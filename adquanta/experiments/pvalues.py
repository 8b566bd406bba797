"""p-values of test statistics; one value per test, after all aggregates."""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these functions with the tasks, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def off_zero(z):
        return np.where(np.abs(z) < tiny, tiny, z)

    c = np.ones_like(x)
    d = 1 / off_zero(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / off_zero(1 + term * d)
            c = off_zero(1 + term / c)
            change = c * d
            value = value * change
        if np.all(np.abs(change - 1) < 1e-15):
            break
    return value


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    out[np.isinf(t)] = 0.0
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if not ok.any():
        return out
    t, df = t[ok], df[ok]
    x = df / (df + t * t)
    rest = t * t / (df + t * t)
    a, b = df / 2, np.full(df.shape, 0.5)
    log_beta = np.array([math.lgamma(p) + math.lgamma(0.5) - math.lgamma(p + 0.5) for p in a])
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log(rest) - log_beta)
    # The fraction converges fast on one side of the mean, so mirror the other.
    lower = x < (a + 1) / (a + b + 2)
    p = np.where(lower,
                 front * _beta_fraction(a, b, np.where(lower, x, 0.0)) / a,
                 1 - front * _beta_fraction(b, a, np.where(lower, 0.0, rest)) / b)
    out[ok] = np.clip(p, 0.0, 1.0)
    return out


@lru_cache
def _cumulative_partitions(parts: int) -> tuple[int, list[int]]:
    """Period L and numerator N with 1 / ((1-q) (1-q)(1-q^2)...(1-q^parts)) = N / (1-q^L)^(parts+1)."""
    period = math.lcm(*range(1, parts + 1))
    numerator = [0] * ((parts + 1) * period)
    numerator[0] = 1
    for d in (1, *range(1, parts + 1)):
        # Times (1 - q^L) / (1 - q^d): running sums in steps of d, less those L back.
        for i in range(d, len(numerator)):
            numerator[i] += numerator[i - d]
        for i in range(len(numerator) - 1, period - 1, -1):
            numerator[i] -= numerator[i - period]
    return period, numerator


def _partitions_up_to(x: int, parts: int) -> int:
    """Partitions of all numbers up to ``x`` into parts of at most ``parts``."""
    if x < 0:
        return 0
    period, numerator = _cumulative_partitions(parts)
    return sum(numerator[j] * math.comb((x - j) // period + parts, parts)
               for j in range(x % period, min(x + 1, len(numerator)), period))


def exact_u_two_sided(u: float, n_a: int, n_b: int) -> float:
    """Exact two-sided p of U without ties, for any size of the larger arm.

    The arrangements per U are the coefficients of a product of
    (1 - q^(n+i)) / (1 - q^i) over the smaller arm. The numerator has at most
    2^m signed terms; each leaves a count of partitions in closed form. All
    numbers are integers up to the last division.
    """
    small, large = sorted((int(n_a), int(n_b)))
    tail = int(math.floor(min(u, n_a * n_b - u)))
    terms = {0: 1}
    for i in range(1, small + 1):
        for power, sign in list(terms.items()):
            terms[power + large + i] = terms.get(power + large + i, 0) - sign
    ways = sum(sign * _partitions_up_to(tail - power, small) for power, sign in terms.items())
    return min(1.0, 2 * ways / math.comb(small + large, small))


@F.pandas_udf(DoubleType())
def welch_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Welch's t."""
    return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float))).replace({np.nan: None})


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, z: pd.Series, n_a: pd.Series, n_b: pd.Series,
                   ties: pd.Series) -> pd.Series:
    """Two-sided p of U: exact when an arm has at most 8 values and nothing
    is tied, else normal. All values equal gives 1."""

    def one(u, z, n_a, n_b, ties):
        if pd.isna(u):
            return None
        if min(n_a, n_b) <= 8 and ties == 0:
            return exact_u_two_sided(u, n_a, n_b)
        return 1.0 if pd.isna(z) else min(1.0, math.erfc(z / math.sqrt(2)))

    return pd.Series([one(*row) for row in zip(u, z, n_a, n_b, ties)], dtype="float64")
