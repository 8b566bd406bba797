"""Derived campaign columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .safe import col, present, ratio

SEVERAL_PLATFORMS = "several"


def high_performer(roas: Column | str = "roas", threshold: float = 5.0) -> Column:
    """1 when the return is strictly above the threshold; null and NaN give 0."""
    return F.when(present(roas) & (col(roas) > F.lit(threshold)), 1).otherwise(0)


def is_multi(platform: Column | str = "platform") -> Column:
    """True for a comma list; a missing platform counts as a single one."""
    return F.coalesce(F.contains(col(platform), F.lit(",")), F.lit(False))


def platform_list(platform: Column | str = "platform") -> Column:
    return F.transform(F.split(col(platform), ","), lambda name: F.trim(name))


def platform_clean(platform: Column | str = "platform",
                   label: str = SEVERAL_PLATFORMS) -> Column:
    return F.when(is_multi(platform), F.lit(label)).otherwise(col(platform))


def relabel(key: Column | str, labels: dict[str, str]) -> Column:
    """Replace known names by labels and keep every other name."""
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), col(key))


def with_features(df: DataFrame, threshold: float = 5.0) -> DataFrame:
    """The campaign table with its eight derived columns."""
    out = df.withColumns({
        "high_performer": high_performer("roas", threshold),
        "budget_utilization": ratio("spent", "budget", 4),
        "clicks_per_day": ratio("clicks", "duration_days", 2),
        "spend_per_impression": ratio("spent", "impressions", 6),
        "revenue_per_click": ratio("revenue", "clicks", 2),
        "is_multi_platform": is_multi("platform").cast("int"),
        "ctr_cr_product": F.round(F.col("ctr_pct") * F.col("cr_pct"), 6),
        "cost_efficiency": ratio("revenue", "spent", 4),
    })
    return out.na.fill(0, ["cac", "revenue_per_click", "cost_efficiency"])


def with_platform_columns(df: DataFrame, label: str = SEVERAL_PLATFORMS) -> DataFrame:
    return df.withColumns({
        "platform_list": platform_list(),
        "is_multi_platform": is_multi(),
        "platform_clean": platform_clean(label=label),
    })
