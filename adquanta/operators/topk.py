"""Ordered, bounded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import above_quantile


def first_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a total order (kept per task, then merged)."""
    return df.orderBy(*order).limit(k)


def with_rank(bounded: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """1-based position in a result that a limit has already made small."""
    return bounded.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def top_above_quantile(df: DataFrame, quantile_of: str, p: float, order_by: str, tie: str,
                       max_k: int = 10_000, share: int = 10) -> DataFrame:
    """Largest ``order_by`` among the rows above a quantile.

    Returns ``min(max_k, rows // share)`` rows; ties are broken by ``tie``.
    """
    k = min(max_k, df.count() // share)
    order = [F.col(order_by).desc(), F.col(tie).asc()]
    return first_rows(above_quantile(df, quantile_of, p), order, k)
