"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.functions.features import platform_list
from adquanta.functions.safe import present

from .quantiles import exact_quantiles


def segment(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def platform_arm(platform: str = "platform") -> Column:
    """``multi`` or ``single``; null for a missing platform, which joins neither."""
    multi = F.contains(F.col(platform), F.lit(","))
    return F.when(multi, "multi").when(~multi, "single")


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(present(c))
    return df


def selection(df: DataFrame, advertisers: list[str] | None = None,
              platforms: list[str] | None = None) -> DataFrame:
    """Rows of the chosen advertisers that run on any of the chosen platforms.

    ``None`` leaves a filter out; an empty list keeps nothing.
    """
    if advertisers is not None:
        df = df.where(F.col("advertiser").isin(advertisers))
    if platforms is not None:
        wanted = F.array(*[F.lit(p) for p in platforms]).cast("array<string>")
        df = df.where(F.arrays_overlap(platform_list(), wanted))
    return df


def above_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows strictly above an exact quantile of the column."""
    (cut,) = exact_quantiles(df, value, [p])
    return df.where(present(value) & (F.col(value) > F.lit(cut)))


def capped_at_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows not above an exact quantile of the column."""
    (cut,) = exact_quantiles(df, value, [p])
    return df.where(F.col(value) <= F.lit(cut))


def above_sigma(df: DataFrame, columns: list[str], sigmas: float = 3.0) -> DataFrame:
    """Rows above mean + ``sigmas`` sample deviations in any of the columns.

    The limits are one scalar subquery, one row computed in one aggregate.
    NaN is missing: it neither moves a limit nor exceeds one.
    """
    limits = df.agg(F.struct(*[
        (F.avg(v) + F.lit(sigmas) * F.stddev_samp(v)).alias(c)
        for c, v in ((c, F.when(present(c), F.col(c))) for c in columns)
    ]).alias("limits")).scalar()
    hit = F.lit(False)
    for c in columns:
        hit = hit | (present(c) & (F.col(c) > limits[c]))
    return df.where(hit)
