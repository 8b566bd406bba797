"""Complete experiment records, corrections, verdicts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adquanta.functions.features import is_multi
from adquanta.functions.labels import effect_text, strength
from adquanta.functions.safe import present

from .bootstrap import difference_intervals, replicate_means
from .moments import arm_moments, with_effects
from .pvalues import mann_whitney_p, welch_p
from .ranks import rank_statistics
from .spec import ExperimentSpec, members, samples, spec_table

KEYS = ["experiment", "metric"]
# Display names of the metrics.
METRIC_LABELS = {"ctr_pct": "CTR", "cr_pct": "CR", "roas": "ROAS", "cac": "CAC",
                 "conversions": "conversions"}


def hypothesis_statistics(member_rows: DataFrame, specs: Sequence[ExperimentSpec]) -> DataFrame:
    """Moments, effect sizes, Welch's t and Mann-Whitney U per hypothesis."""
    long = samples(member_rows, specs)
    moments = with_effects(arm_moments(long, KEYS))
    ranks = rank_statistics(long, KEYS).drop("rank_n_a", "rank_n_b")
    return moments.join(ranks, KEYS)


def with_significance(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add both p-values and the flags; a missing p is not significant."""
    out = tests.withColumns({
        "p_value_ttest": welch_p("t_statistic", "welch_df"),
        "p_value_mwu": mann_whitney_p("u_statistic", "u_z", "n_a", "n_b", "tie_term"),
    })
    return with_flags(out, "p_value_ttest", "p_value_mwu", alpha)


def with_flags(tests: DataFrame, p_t: str, p_u: str, alpha: float = 0.05) -> DataFrame:
    def below(p: str) -> Column:
        return F.coalesce(F.col(p) < F.lit(alpha), F.lit(False))

    return tests.withColumns({
        "significant_ttest": below(p_t),
        "significant_mwu": below(p_u),
        "significant_both": below(p_t) & below(p_u),
    })


def run_experiments(df: DataFrame, specs: Sequence[ExperimentSpec], id_col: str = "ad_id",
                    alpha: float = 0.05, replicates: int = 2000, level: float = 0.95,
                    cells: int | None = None, seed: int = 0) -> DataFrame:
    """All hypotheses of all experiments, one record each.

    ``df`` is read several times (value ranges, moments, ranks, resampling);
    stage it first if it is expensive to compute.
    """
    rows = members(df, specs, id_col, ranges=True)
    tests = with_significance(hypothesis_statistics(rows, specs), alpha)
    intervals = difference_intervals(
        replicate_means(rows, specs, replicates, cells, seed), level)
    named = spec_table(df, specs)
    # All three sides have one row per declared hypothesis.
    return named.join(tests, KEYS).join(intervals, KEYS)


def with_bonferroni(tests: DataFrame, alpha: float = 0.05, p: str = "p_value_ttest") -> DataFrame:
    """Corrected level and verdict within each experiment, and the family level."""
    within = Window.partitionBy("experiment")
    out = tests.withColumn("bonferroni_alpha", F.lit(alpha) / F.count("*").over(within))
    hit = F.coalesce(F.col(p) < F.col("bonferroni_alpha"), F.lit(False))
    return out.withColumn("significant_bonferroni", hit).withColumn(
        "n_significant_bonferroni", F.count_if(hit).over(within))


def with_verdict(tests: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Winner, loser and direction by the larger mean.

    Metrics named in ``lower_is_better`` are won by the smaller mean.
    """
    greater = F.col("mean_b") > F.col("mean_a")
    inverted = F.col("metric").isin(list(lower_is_better)) if lower_is_better else F.lit(False)
    b_wins = F.when(inverted, F.col("mean_b") < F.col("mean_a")).otherwise(greater)
    return tests.withColumns({
        "winner": F.when(b_wins, F.col("group_b")).otherwise(F.col("group_a")),
        "loser": F.when(b_wins, F.col("group_a")).otherwise(F.col("group_b")),
        "direction": F.when(greater, "up").otherwise("down"),
    })


def totals(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    return tests.agg(
        F.count("*").alias("n_tests"),
        F.count_if("significant_both").alias("n_significant"),
        F.count_if(~F.col("significant_both")).alias("n_not_significant"),
        F.round(F.try_divide(F.lit(alpha), F.count("*")), 4).alias("family_alpha"),
    )


def nested_report(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One document with totals and an array of tests, ready for a JSON sink.

    The array holds the declared hypotheses, whose number the specs fix.
    """
    def r(c: str, digits: int) -> Column:
        return F.round(c, digits).alias(c)

    entry = F.struct(
        "test_no",
        F.concat_ws(" vs ", "group_a", "group_b").alias("name"), "metric",
        r("mean_a", 4), r("mean_b", 4), r("lift_pct", 2), r("p_value_ttest", 4),
        r("p_value_mwu", 4), r("cohens_d", 4), "effect_size",
        F.col("significant_both").alias("significant"),
        F.array(F.round("ci_lower", 4), F.round("ci_upper", 4)).alias("ci_95"),
    )
    return tests.agg(
        F.count("*").alias("total_hypotheses"),
        F.count_if("significant_both").alias("significant_hypotheses"),
        F.round(F.try_divide(F.lit(alpha), F.count("*")), 4).alias("bonferroni_alpha"),
        F.array_sort(F.collect_list(entry)).alias("experiments"),
    )


def advertiser_tests(df: DataFrame, key: str = "advertiser",
                     metrics: Sequence[str] = ("roas", "ctr_pct", "conversions"),
                     platform: str = "platform", min_n: int = 2, warn_n: int = 3) -> DataFrame:
    """Single against multi-platform rows per advertiser and metric.

    One aggregate keyed by advertiser and metric. Pairs with an arm below
    ``min_n`` drop out; pairs with one of at most ``warn_n`` are flagged.
    """
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics
    ])
    long = df.select(
        key, F.when(is_multi(platform), "b").otherwise("a").alias("arm"), F.inline(entries),
    ).where(present("value"))
    tests = arm_moments(long, [key, "metric"]).where(
        (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    return with_effects(tests, zero_sd="epsilon").withColumn(
        "small_sample", F.least("n_a", "n_b") <= warn_n)


def advertiser_table(tests: DataFrame, key: str = "advertiser", alpha: float = 0.05) -> DataFrame:
    """Rounded presentation of :func:`advertiser_tests` with p-values."""
    p = welch_p("t_statistic", "welch_df")

    def shown(mean: str) -> Column:
        whole = F.col("metric") == "conversions"
        return F.when(whole, F.bround(mean, 0)).otherwise(F.bround(mean, 2)).alias(mean)

    rounded = tests.withColumn("_p", p).select(
        key, "metric", shown("mean_a"), shown("mean_b"), "n_a", "n_b",
        F.round("t_statistic", 3).alias("t_statistic"),
        F.round("_p", 4).alias("p_value"),
        F.round("cohens_d", 3).alias("cohens_d"),
        "effect_size", "small_sample",
        F.coalesce(F.col("_p") < F.lit(alpha), F.lit(False)).alias("significant"),
    )
    return rounded.withColumns({
        "signif_log": strength("p_value"),
        "d_label": effect_text("cohens_d"),
    })
