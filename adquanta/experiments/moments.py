"""Per-arm moments and the statistics that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.functions.labels import EFFECT_LABELS, effect_label


def arm_moments(long: DataFrame, keys: list[str], value: str = "value",
                arm: str = "arm") -> DataFrame:
    """Size, mean and sample deviation of arms ``a`` and ``b`` in one aggregate."""
    out = []
    for side in ("a", "b"):
        v = F.when(F.col(arm) == side, F.col(value))
        out += [
            F.count(v).alias(f"n_{side}"),
            F.avg(v).alias(f"mean_{side}"),
            F.stddev_samp(v).alias(f"std_{side}"),
        ]
    return long.groupBy(*keys).agg(*out)


def lift_percent() -> Column:
    change = F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")) * 100
    return F.when(F.col("mean_a") == 0, F.lit(0.0)).otherwise(change)


def cohens_d(zero_sd: str = "zero") -> Column:
    """Mean difference a - b over the pooled sample deviation.

    Constant samples give 0 (``zero_sd="zero"``), or the pooled deviation is
    kept off zero by 1e-9 (``"epsilon"``). Arms of fewer than 2 rows give null.
    """
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide(
        (na - 1) * F.col("std_a") * F.col("std_a") + (nb - 1) * F.col("std_b") * F.col("std_b"),
        na + nb - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    if zero_sd == "epsilon":
        d = diff / (pooled + F.lit(1e-9))
    elif zero_sd == "zero":
        d = F.when(pooled == 0, F.lit(0.0)).otherwise(F.try_divide(diff, pooled))
    else:
        raise ValueError(f"unknown zero_sd: {zero_sd}")
    return F.when((na >= 2) & (nb >= 2), d)


def welch_t() -> Column:
    """Unequal-variance t of mean_a - mean_b; infinite for two constant samples."""
    diff = F.col("mean_a") - F.col("mean_b")
    error = F.sqrt(_share("a") + _share("b"))
    return (
        F.when(error > 0, F.try_divide(diff, error))
        .when((error == 0) & (diff > 0), F.lit(float("inf")))
        .when((error == 0) & (diff < 0), F.lit(float("-inf")))
    )


def welch_df() -> Column:
    """Welch-Satterthwaite degrees of freedom; 1 for two constant samples."""
    a, b = _share("a"), _share("b")
    parts = (F.try_divide(a * a, F.col("n_a") - 1) + F.try_divide(b * b, F.col("n_b") - 1))
    df = F.try_divide((a + b) * (a + b), parts)
    return F.when(parts == 0, F.lit(1.0)).otherwise(df)


def _share(side: str) -> Column:
    """Variance of one arm's mean."""
    return F.try_divide(F.col(f"std_{side}") * F.col(f"std_{side}"), F.col(f"n_{side}"))


def with_effects(moments: DataFrame, zero_sd: str = "zero",
                 labels: tuple[str, ...] = EFFECT_LABELS) -> DataFrame:
    """Add lift, Cohen's d with its label, Welch's t and degrees of freedom."""
    return moments.withColumns({
        "lift_pct": lift_percent(),
        "cohens_d": cohens_d(zero_sd),
        "t_statistic": welch_t(),
        "welch_df": welch_df(),
    }).withColumn("effect_size", effect_label("cohens_d", labels))
