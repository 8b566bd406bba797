"""Declaration of experiments and the sample tables made from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adquanta.functions.safe import present
from adquanta.operators.quantiles import with_value_ranges


@dataclass(frozen=True)
class ExperimentSpec:
    """Two segments, given as SQL predicates, compared on some metrics."""

    name: str
    label_a: str
    label_b: str
    where_a: str
    where_b: str
    metrics: tuple[str, ...]


# Segments of the standard comparisons.
AGES = ("25-34", "45-54")
PLATFORMS = ("Facebook", "Instagram")
ADVERTISERS = ("Forte Bank", "Kaspi")


def campaign_experiments(age_a: str = AGES[0], age_b: str = AGES[1],
                         platform_a: str = PLATFORMS[0], platform_b: str = PLATFORMS[1],
                         advertiser_a: str = ADVERTISERS[0],
                         advertiser_b: str = ADVERTISERS[1]) -> list[ExperimentSpec]:
    """The four standard comparisons, 14 hypotheses in all."""

    def equal(column: str, value: str) -> str:
        quoted = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"{column} = '{quoted}'"

    return [
        ExperimentSpec("age", age_a, age_b, equal("target_age", age_a),
                       equal("target_age", age_b), ("ctr_pct", "cr_pct", "roas", "cac")),
        ExperimentSpec("platform", platform_a, platform_b, equal("platform", platform_a),
                       equal("platform", platform_b), ("ctr_pct", "roas", "cr_pct")),
        ExperimentSpec("multi_platform", "single", "multi", "not contains(platform, ',')",
                       "contains(platform, ',')", ("ctr_pct", "roas", "conversions")),
        ExperimentSpec("advertiser", advertiser_a, advertiser_b,
                       equal("advertiser", advertiser_a), equal("advertiser", advertiser_b),
                       ("ctr_pct", "cr_pct", "roas", "cac")),
    ]


def all_metrics(specs: Sequence[ExperimentSpec]) -> list[str]:
    return list(dict.fromkeys(m for s in specs for m in s.metrics))


def members(df: DataFrame, specs: Sequence[ExperimentSpec], id_col: str = "ad_id",
            ranges: bool | int = False) -> DataFrame:
    """One row per (experiment, arm, row): ``row_id`` and the metric columns.

    One scan serves all experiments; a row takes part in several of them.
    ``ranges`` adds the value range of each metric, which rank statistics and
    medians use: a number of ranges, or yes for one that follows the rows.
    """
    metrics = all_metrics(specs)
    slots = [
        F.when(F.expr(s.where_a), F.struct(F.lit(s.name).alias("experiment"), F.lit("a").alias("arm")))
        .when(F.expr(s.where_b), F.struct(F.lit(s.name).alias("experiment"), F.lit("b").alias("arm")))
        for s in specs
    ]
    rows = df.select(
        F.col(id_col).cast("string").alias("row_id"),
        *[F.when(present(m), F.col(m).cast("double")).alias(m) for m in metrics],
        F.array_compact(F.array(*slots)).alias("_slots"),
    ).where(F.size("_slots") > 0)
    if ranges:
        rows = with_value_ranges(rows, metrics, ranges=None if ranges is True else ranges)
    kept = [c for c in rows.columns if c != "_slots"]
    return rows.select(F.explode("_slots").alias("_m"), *kept).select(
        "_m.experiment", "_m.arm", *kept)


def samples(member_rows: DataFrame, specs: Sequence[ExperimentSpec]) -> DataFrame:
    """Long form: one row per (experiment, metric, arm, value), no missing values."""
    metrics = all_metrics(specs)
    with_range = f"{metrics[0]}_range" in member_rows.columns

    def entry(m: str):
        extra = [F.col(f"{m}_range").alias("value_range")] if with_range else []
        return F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), *extra)

    # Only the metrics of a row's own experiment are laid out.
    own = F.lit(None)
    for s in specs:
        own = F.when(F.col("experiment") == s.name, F.array(*[entry(m) for m in s.metrics])).otherwise(own)
    out = member_rows.select("experiment", "arm", "row_id", F.inline(own))
    return out.where(F.col("value").isNotNull())


# The sums behind each metric of a whole segment, and its scale.
RATIOS = {
    "ctr_pct": ("clicks", "impressions", 100.0),
    "cr_pct": ("conversions", "clicks", 100.0),
    "roas": ("revenue", "spent", 1.0),
    "cac": ("spent", "conversions", 1.0),
    "conversions": ("conversions", None, 1.0),
}


def ratio_samples(df: DataFrame, specs: Sequence[ExperimentSpec], id_col: str = "ad_id") -> DataFrame:
    """Long form of the sums behind the metrics: ``top`` and ``bottom`` per (experiment, metric, arm, row_id).

    The metric of a segment is sum(top) / sum(bottom), which weights rows by their
    size; a metric without a denominator is a mean. Rows with a missing part are left out.
    """
    parts = tuple(dict.fromkeys(c for m in all_metrics(specs) for c in RATIOS[m][:2] if c))
    wide = members(df, [replace(s, metrics=parts) for s in specs], id_col)

    def entry(m: str):
        top, bottom, scale = RATIOS[m]
        return F.struct(F.lit(m).alias("metric"), (F.col(top) * scale).alias("top"),
                        (F.col(bottom) if bottom else F.lit(1.0)).alias("bottom"))

    own = F.lit(None)
    for s in specs:
        own = F.when(F.col("experiment") == s.name, F.array(*[entry(m) for m in s.metrics])).otherwise(own)
    return wide.select("experiment", "arm", "row_id", F.inline(own)).dropna(subset=["top", "bottom"])


def spec_table(df: DataFrame, specs: Sequence[ExperimentSpec]) -> DataFrame:
    """The hypotheses as rows; as many as the specs declare."""
    rows = [(i, s.name, m, s.label_a, s.label_b)
            for i, (s, m) in enumerate((s, m) for s in specs for m in s.metrics)]
    return df.sparkSession.createDataFrame(
        rows, "test_no int, experiment string, metric string, group_a string, group_b string")
