"""Mann-Whitney U and medians from value histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adquanta.functions.safe import present
from adquanta.operators.quantiles import (
    quantile_from_counts,
    with_running_counts,
    with_value_ranges,
)


def rank_statistics(long: DataFrame, keys: list[str], value: str = "value",
                    range_col: str = "value_range", arm: str = "arm") -> DataFrame:
    """Per group: medians of both arms, U of arm a, tie term and z.

    Equal values collapse to one row with two counts before any ordering, so
    ranks need no row-level sort and ties cost nothing. The mid-rank of a
    value is the number of smaller items plus half of its own, plus a half.
    ``z`` has the continuity correction and the tie-corrected deviation.
    Samples without a range column get one here.
    """
    if range_col not in long.columns:
        long = with_value_ranges(long, [value]).withColumnRenamed(f"{value}_range", range_col)
    hist = long.groupBy(*keys, range_col, value).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(arm) == "a").alias("a"),
        F.count_if(F.col(arm) == "b").alias("b"),
    )
    running = with_running_counts(hist, keys, value, range_col, ["n", "a", "b"])
    n = F.col("n").cast("double")
    mid_rank = F.col("n_before") + (n + 1) / 2
    out = running.groupBy(*keys).agg(
        F.max("a_total").alias("rank_n_a"),
        F.max("b_total").alias("rank_n_b"),
        quantile_from_counts(value, "a", 0.5).alias("median_a"),
        quantile_from_counts(value, "b", 0.5).alias("median_b"),
        F.sum(F.col("a") * mid_rank).alias("_rank_sum"),
        F.sum(n * n * n - n).alias("tie_term"),
    )
    na, nb = F.col("rank_n_a").cast("double"), F.col("rank_n_b").cast("double")
    total = na + nb
    u = F.col("_rank_sum") - na * (na + 1) / 2
    spread = F.sqrt(
        na * nb / 12 * (total + 1 - F.try_divide(F.col("tie_term"), total * (total - 1))))
    both = (na > 0) & (nb > 0)
    out = out.withColumn("u_statistic", F.when(both, u))
    larger = F.greatest(F.col("u_statistic"), na * nb - F.col("u_statistic"))
    return out.withColumn(
        "u_z", F.when(both, F.try_divide(larger - na * nb / 2 - 0.5, spread))).drop("_rank_sum")


def roc_area(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve as U / (positives * negatives), ties halved.

    Rows without a score are left out.
    """
    arms = df.select(
        F.lit(1).alias("_all"), F.col(score).cast("double").alias("value"),
        F.when(F.col(label) == 1, "a").otherwise("b").alias("arm")).where(present("value"))
    stats = rank_statistics(arms, ["_all"])
    pairs = F.col("rank_n_a").cast("double") * F.col("rank_n_b")
    return stats.select(
        F.col("rank_n_a").alias("positives"), F.col("rank_n_b").alias("negatives"),
        F.try_divide(F.col("u_statistic"), pairs).alias("auc"))
