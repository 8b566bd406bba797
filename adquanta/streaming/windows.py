"""Windows of a fixed number of events, and alerts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.operators.positions import window_number, with_position
from adquanta.operators.topk import first_rows

# Default window size and alert limits.
WINDOW_SIZE = 100
LOW_CTR = 0.5
MIN_TOTAL = 30

ORDER = ["ts", "event_id"]


def window_counts(positioned: DataFrame, size: int, keys: list[str]) -> DataFrame:
    kind = F.col("event_type")
    return positioned.groupBy(*keys, window_number("position", size).alias("window")).agg(
        F.count("*").alias("total"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "conversion").alias("conversions"),
    )


def merge_windows(partials: DataFrame, keys: list[str]) -> DataFrame:
    return partials.groupBy(*keys, "window").agg(
        *[F.sum(c).alias(c) for c in ("total", "clicks", "conversions")])


def with_window_ctr(windows: DataFrame) -> DataFrame:
    """Clicks per hundred events of any type."""
    return windows.withColumn("ctr", F.try_divide(F.col("clicks") * 100, F.col("total")))


def count_windows(events: DataFrame, size: int = WINDOW_SIZE, keys: list[str] | None = None,
                  order: list[str] = ORDER) -> DataFrame:
    """Consecutive windows of ``size`` events in event order; the last may be short.

    Without keys the windows run over the whole table. Positions come from
    range slices, so neither a hot key nor the whole table meets in one task.
    """
    keys = keys or []
    used = events.select(*dict.fromkeys([*keys, *order, "event_type"]))
    positioned = with_position(used, order, keys, "position")
    return with_window_ctr(window_counts(positioned, size, keys))


def alerts(windows: DataFrame, low_ctr: float = LOW_CTR, min_total: int = MIN_TOTAL) -> DataFrame:
    """Zero, one or two alerts per window, by the rule table below."""

    def rule(when: Column, kind: str, message: Column, severity: str) -> Column:
        return F.when(when, F.struct(
            F.lit(kind).alias("type"), message.alias("message"),
            F.lit(severity).alias("severity")))

    ctr_text = F.format_string(f"CTR = %.2f%% is below {low_ctr}%%", F.col("ctr"))
    empty_text = F.format_string("no conversions in a window of %d events", F.col("total"))
    fired = F.array_compact(F.array(
        rule(F.col("ctr") < low_ctr, "LOW_CTR", ctr_text, "WARNING"),
        rule((F.col("conversions") == 0) & (F.col("total") > min_total),
             "ZERO_CONVERSIONS", empty_text, "CRITICAL"),
    ))
    metrics = ("total", "clicks", "conversions", "ctr")
    keys = [c for c in windows.columns if c not in metrics]
    return windows.select(*keys, F.inline(fired))


def last_alerts(alert_rows: DataFrame, k: int = 5) -> DataFrame:
    """Alerts of the latest windows; ties are ordered by the other columns."""
    rest = [F.col(c).asc() for c in alert_rows.columns if c not in ("window", "message")]
    return first_rows(alert_rows, [F.col("window").desc(), *rest], k)
