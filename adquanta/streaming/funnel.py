"""Funnel counters and ratios; the same code serves batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.functions.safe import ratio, ratio_or_zero

COUNTERS = ("impressions", "clicks", "conversions", "bounces", "revenue", "cost", "events")


def counter_columns() -> list[Column]:
    """Counts per event type; revenue of conversions only, cost of every event."""
    kind = F.col("event_type")
    return [
        F.count_if(kind == "impression").alias("impressions"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "conversion").alias("conversions"),
        F.count_if(kind == "bounce").alias("bounces"),
        F.coalesce(F.sum(F.when(kind == "conversion", F.col("revenue"))), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count("*").alias("events"),
    ]


def funnel_counters(events: DataFrame, *keys: str | Column) -> DataFrame:
    return events.groupBy(*keys).agg(*counter_columns())


def merge_counters(partials: DataFrame, *keys: str) -> DataFrame:
    """Add up counters that were computed apart, for instance per consumer."""
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def with_ratios(counters: DataFrame, cac_when_empty: float | None = None) -> DataFrame:
    """CTR, CR, ROAS and CAC, 0 where a denominator is 0.

    Without conversions CAC is ``cac_when_empty``.
    """
    empty = F.lit(cac_when_empty).cast("double")
    return counters.withColumns({
        "ctr_pct": ratio_or_zero("clicks", "impressions", 100, 3),
        "cr_pct": ratio_or_zero("conversions", "clicks", 100, 3),
        "roas": ratio_or_zero("revenue", "cost", 1, 2),
        "cac": F.when(F.col("conversions") > 0, ratio("cost", "conversions", 0)).otherwise(empty),
        "cost": F.round("cost", 0),
        "revenue": F.round("revenue", 0),
    })


def funnel_report(events: DataFrame, *keys: str, cac_when_empty: float | None = None) -> DataFrame:
    """Ratios per key, best return first."""
    return with_ratios(funnel_counters(events, *keys), cac_when_empty).orderBy(
        F.desc("roas"), *keys)


def time_windows(events: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = (),
                 watermark: str | None = None) -> DataFrame:
    """Funnel counters per event-time window (tumbling, or sliding by ``slide``).

    With a watermark a stream drops later rows and releases finished windows.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    return funnel_counters(events, frame, *keys).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, *COUNTERS)
