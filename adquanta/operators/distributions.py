"""Histogram and box summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adquanta.functions.safe import present

from .joins import join_dimension
from .quantiles import grouped_quantiles
from .segments import capped_at_quantile


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 40) -> DataFrame:
    """Row counts per equal-width bin between minimum and maximum.

    The maximum belongs to the last bin.
    """
    clean = df.where(present(value))
    ends = clean.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / F.lit(bins)
    step = F.floor(F.try_divide(F.col(value) - ends["lo"], width))
    number = F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1)) + 1
    return (
        clean.select(*by, number.cast("int").alias("bin"))
        .groupBy("bin", *by)
        .agg(F.count("*").alias("n"))
    )


def box_summary(df: DataFrame, keys: list[str], value: str, cap: float | None = None,
                fence: float = 1.5) -> DataFrame:
    """Quartiles and whisker ends per group, optionally below a cap quantile.

    A whisker ends at the furthest value within ``fence`` interquartile ranges
    of the box.
    """
    rows = df.select(*keys, value).where(present(value))
    if cap is not None:
        rows = capped_at_quantile(rows, value, cap)
    boxes = grouped_quantiles(rows, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = F.lit(fence) * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        join_dimension(rows, boxes, keys)
        .groupBy(*keys)
        .agg(
            F.first("n").alias("n"),
            F.first("q1").alias("q1"), F.first("q2").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        )
    )
