"""Campaign reports: KPI tables, class balance, correlations, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adquanta.functions.labels import PRIORITIES
from adquanta.functions.safe import pearson


def class_balance(df: DataFrame, flag: str = "high_performer") -> DataFrame:
    """Positives, negatives and their percentages in one aggregate."""
    positives = F.coalesce(F.sum(flag), F.lit(0))
    n = F.count("*")
    return df.agg(
        n.alias("n"), positives.alias("positives"), (n - positives).alias("negatives"),
        F.round(F.try_divide(positives * 100, n), 1).alias("pct_positive"),
        F.round(F.try_divide((n - positives) * 100, n), 1).alias("pct_negative"),
    )


def advertiser_kpis(df: DataFrame) -> DataFrame:
    return df.groupBy("advertiser").agg(
        F.count("*").alias("n"),
        F.round(F.avg("ctr_pct"), 3).alias("ctr"),
        F.round(F.avg("cr_pct"), 3).alias("cr"),
        F.round(F.avg("cac"), 0).alias("cac"),
        F.round(F.avg("roas"), 2).alias("roas"),
        F.round(F.sum("spent") / 1e6, 1).alias("spend_mln"),
        F.sum("high_performer").alias("high_perf_count"),
    ).orderBy(F.desc("roas"), "advertiser")


def age_kpis(df: DataFrame) -> DataFrame:
    return df.groupBy("target_age").agg(
        F.count("*").alias("n"),
        F.round(F.avg("ctr_pct"), 3).alias("ctr"),
        F.round(F.avg("cac"), 0).alias("cac"),
        F.round(F.avg("roas"), 2).alias("roas"),
        F.sum("conversions").alias("conv"),
        F.round(F.avg("high_performer") * 100, 1).alias("pct_high_perf"),
    ).orderBy("cac", "target_age")


def platform_kpis(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(
        F.count("*").alias("n"),
        F.round(F.avg("ctr_pct"), 3).alias("ctr"),
        F.round(F.avg("roas"), 2).alias("roas"),
        F.round(F.avg("high_performer") * 100, 1).alias("pct_high_perf"),
    ).orderBy(F.desc("roas"), "platform")


# The reported pairs and their column names.
CORRELATION_PAIRS = (
    ("impressions", "conversions", "corr_imp_conv"),
    ("ctr_pct", "cr_pct", "corr_ctr_cr"),
    ("ctr_cr_product", "roas", "corr_ctr_cr_roas"),
    ("budget_utilization", "roas", "corr_util_roas"),
    ("cost_efficiency", "high_performer", "corr_eff_hp"),
)


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str, str]] = CORRELATION_PAIRS,
                 digits: int = 4) -> DataFrame:
    """All Pearson correlations in one aggregate."""
    return df.agg(*[F.round(pearson(x, y), digits).alias(name) for x, y, name in pairs])


def advertiser_display(df: DataFrame) -> DataFrame:
    """Rounded means and sums per advertiser for a table view."""
    raw = df.groupBy("advertiser").agg(
        F.avg("ctr_pct").alias("ctr"), F.avg("roas").alias("roas"), F.avg("cac").alias("cac"),
        F.sum("conversions").alias("conversions"), F.sum("spent").alias("spent"),
        F.sum("impressions").alias("impressions"),
    ).orderBy(F.desc("roas"), "advertiser")
    return raw.withColumns({
        "ctr": F.round("ctr", 2), "roas": F.round("roas", 2),
        "cac": F.bround("cac", 0).cast("bigint"),
    })


def kpi_bar(df: DataFrame) -> DataFrame:
    """Headline figures of a selection: millions of impressions, thousands of clicks."""
    return df.agg(
        F.round(F.sum("impressions") / 1e6, 3).alias("impressions_mln"),
        F.round(F.sum("clicks") / 1e3, 3).alias("clicks_k"),
        F.round(F.avg("ctr_pct"), 2).alias("ctr"),
        F.round(F.avg("roas"), 2).alias("roas"),
        F.sum("conversions").alias("conversions"),
    )


def priority_summary(df: DataFrame, score: str = "conv_score") -> DataFrame:
    return df.groupBy("priority").agg(
        F.count("ad_id").alias("campaigns"),
        F.round(F.avg("cac"), 2).alias("avg_cac"),
        F.round(F.avg("roas"), 2).alias("avg_roas"),
        F.round(F.avg(score), 2).alias("avg_score"),
    )


def segment_report(df: DataFrame, score: str = "conv_score") -> DataFrame:
    return df.groupBy("advertiser", "target_age", "priority").agg(
        F.count("ad_id").alias("campaigns"),
        F.round(F.avg("ctr_pct"), 3).alias("avg_ctr"),
        F.round(F.avg("cac"), 3).alias("avg_cac"),
        F.round(F.avg("roas"), 3).alias("avg_roas"),
        F.round(F.avg(score), 3).alias("avg_score"),
    )


def priority_levels(df: DataFrame, levels: Sequence[str] = PRIORITIES) -> DataFrame:
    """Rows per level in one row; a level without rows counts 0."""
    return df.agg(*[F.count_if(F.col("priority") == p).alias(p.lower()) for p in levels])


def group_size(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str],
                 fill: int | None = 0) -> DataFrame:
    """Cross table of row counts; the listed values become columns."""
    out = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return out if fill is None else out.na.fill(fill, list(values))


def pivot_sum(df: DataFrame, row: str, column: str, values: Sequence[str], measure: str,
              fill: float | None = 0.0, other: str | None = None) -> DataFrame:
    """Cross table of sums; the listed values become columns.

    With ``other`` a column of that name sums the rows whose value is null or
    not listed, so that the columns of a row add up to its whole sum.
    """
    names = list(values)
    if other is not None:
        if other in names:
            raise ValueError(f"{other!r} is one of the listed values")
        listed = F.coalesce(F.col(column).isin(names), F.lit(False))
        df = df.select(row, F.when(listed, F.col(column)).otherwise(F.lit(other)).alias(column), measure)
        names.append(other)
    out = df.groupBy(row).pivot(column, names).agg(F.sum(measure))
    if fill is None:
        return out
    names = [c for c in out.columns if c != row]
    return out.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) for c in names])


def common_values(df: DataFrame, column: str, k: int) -> list:
    """The ``k`` commonest values, ties in their order; two passes at any number of values.

    A bounded sketch proposes candidates: every value of more than a share of
    1 / (8k) of the rows is among them. They are then counted exactly. If fewer
    than ``k`` of them pass that share, rarer values could be among the first
    ``k``, and all values are counted.
    """
    n = df.count()
    if not n:
        return []
    proposed = df.stat.freqItems([column], 1 / (8 * k)).first()[0]
    known = F.col(column).isin(proposed) if proposed else F.lit(False)
    counts = df.where(known).groupBy(column).count().orderBy(F.desc("count"), column).limit(k + 1).collect()
    if sum(row["count"] > n / (8 * k) for row in counts) < k:
        counts = df.where(F.col(column).isNotNull()).groupBy(column).count() \
            .orderBy(F.desc("count"), column).limit(k).collect()
    return [row[column] for row in counts[:k]]


def pivot_sum_common(df: DataFrame, row: str, column: str, measure: str, k: int, other: str) -> DataFrame:
    """Cross table of sums over the ``k`` commonest values of a column; ``other`` holds the rest.

    Columns come from the data, and none of its sum is lost. A cell without rows is null.
    """
    return pivot_sum(df, row, column, common_values(df, column, k), measure, None, other)


def three_key_report(df: DataFrame, keys: Sequence[str] = ("advertiser", "platform", "target_age"),
                     count: str = "ad_id") -> DataFrame:
    """Seven measures per key combination."""
    return df.groupBy(*keys).agg(
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("conversions").alias("total_conversions"),
        F.sum("spent").alias("total_spent"),
        F.avg("ctr_pct").alias("avg_ctr"),
        F.avg("roas").alias("avg_roas"),
        F.count(count).alias("campaigns"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def distinct_members(df: DataFrame, array_column: str, out: str) -> DataFrame:
    """Distinct elements of an array column, sorted."""
    return distinct_values(df.select(F.explode(array_column).alias(out)), out)


def cardinality(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in columns])
