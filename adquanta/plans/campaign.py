"""Queries on campaigns: features, filters, reports, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adquanta.functions.features import (
    platform_clean,
    relabel,
    with_features,
    with_platform_columns,
)
from adquanta.functions.labels import PRIORITIES
from adquanta.operators import kpis
from adquanta.operators.distributions import box_summary, histogram
from adquanta.operators.joins import with_group_mean
from adquanta.operators.quantiles import approximate_quantile, exact_quantiles, grouped_quantiles
from adquanta.operators.scoring import (
    composite_score,
    fixed_priority,
    rescaled,
    sigmoid_margin,
    tercile_priority,
)
from adquanta.operators.segments import above_sigma, platform_arm, segment, selection
from adquanta.operators.topk import first_rows, top_above_quantile, with_rank
from adquanta.schemas import CAMPAIGN
from adquanta.session import fresh_path, stage
from adquanta.sources import files
from adquanta.sources.tables import PLATFORMS, campaigns

from .common import CAMPAIGNS, FEATURES, SCORED, r, registry, rounded

QUERIES, SQL, query = registry()

# Selections that the filter queries use.
ADVERTISERS = ["NATION_1", "NATION_7", "NATION_8", "NATION_20"]
CHOSEN_PLATFORMS = ["A", "R"]
SQL_ADVERTISERS = "'NATION_1', 'NATION_7', 'NATION_8', 'NATION_20'"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(campaigns(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Composite score and priority; the passes share one staged projection."""
    wanted = dict.fromkeys(["ad_id", "roas", "ctr_pct", "cr_pct", *columns])
    base = stage(campaigns(spark, sf_dir).select(*wanted), "campaigns")
    return tercile_priority(composite_score(base))


def squashed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A model-free score on plain columns: margin of return against the cut."""
    df = campaigns(spark, sf_dir).select("ad_id", "roas", *columns)
    score = sigmoid_margin(F.lit(5.0), F.col("roas"))
    return rescaled(stage(df.withColumn("conv_score", score), "scores"), "conv_score")


SQUASHED = CAMPAIGNS + """,
raw AS (SELECT *, coalesce(1 / (1 + exp(-(roas - 5))), 0.5) AS raw_score FROM campaigns),
raw_ends AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM raw),
squashed AS (SELECT raw.*, (raw_score - lo) / (hi - lo) AS conv_score FROM raw, raw_ends),
labelled AS (
  SELECT *, CASE WHEN conv_score >= 0.70 THEN 'HIGH' WHEN conv_score >= 0.48 THEN 'MEDIUM' ELSE 'LOW' END
           AS priority FROM squashed)"""


# Sources -----------------------------------------------------------------

@query(f"""WITH {CAMPAIGNS}
SELECT CAST(ad_id AS VARCHAR) AS ad_id, advertiser, country, strftime(start_date, '%Y-%m-%d %H:%M:%S') AS start_date,
       CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS collected_at, CAST(NULL AS VARCHAR) AS source,
       platform, target_age, target_gender, duration_days, impressions, clicks, conversions,
       {r('ctr_pct', 6)} AS ctr_pct, {r('cr_pct', 6)} AS cr_pct, {r('spent', 3)} AS spent, {r('cpc', 6)} AS cpc,
       {r('cac', 6)} AS cac, {r('revenue', 2)} AS revenue, {r('roas', 6)} AS roas, {r('budget', 3)} AS budget
FROM campaigns""")
def src_csv_roundtrip(spark, sf_dir):
    """The campaign table written as CSV and read back with the fixed schema."""
    have = campaigns(spark, sf_dir)
    extra = {c: F.lit(None).cast("string") for c in ("status", "collected_at", "source")}
    full = have.withColumns(extra).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CAMPAIGN.fields])
    path = fresh_path(spark, "campaign-csv")
    files.write_csv(full, path)
    back = files.read_campaigns(spark, path)
    return rounded(back, {"ctr_pct": 6, "cr_pct": 6, "spent": 3, "cpc": 6, "cac": 6, "revenue": 2, "roas": 6,
                          "budget": 3})


# Derived columns ---------------------------------------------------------

@query(f"""WITH {FEATURES}
SELECT ad_id, high_performer, budget_utilization, clicks_per_day, spend_per_impression,
       revenue_per_click, is_multi_platform, ctr_cr_product, cost_efficiency, {r('cac', 4)} AS cac
FROM feats""")
def feat_campaign(spark, sf_dir):
    return rounded(features(spark, sf_dir).select(
        "ad_id", "high_performer", "budget_utilization", "clicks_per_day", "spend_per_impression",
        "revenue_per_click", "is_multi_platform", "ctr_cr_product", "cost_efficiency", "cac"),
        {"cac": 4})


@query(f"""WITH {CAMPAIGNS}
SELECT ad_id, array_to_string(string_split(platform, ','), '|') AS platform_list,
       coalesce(platform LIKE '%,%', false) AS is_multi_platform,
       CASE WHEN platform LIKE '%,%' THEN 'several' ELSE platform END AS platform_clean,
       CASE WHEN platform LIKE '%,%' THEN 'Several (B)' ELSE 'Single (A)' END AS platform_type,
       CASE target_gender WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE target_gender END AS status_label
FROM campaigns""")
def feat_platform(spark, sf_dir):
    df = with_platform_columns(campaigns(spark, sf_dir))
    kind = F.when(F.col("is_multi_platform"), "Several (B)").otherwise("Single (A)")
    return df.select(
        "ad_id", F.array_join("platform_list", "|").alias("platform_list"), "is_multi_platform",
        "platform_clean", kind.alias("platform_type"),
        relabel("target_gender", {"F": "filled", "O": "open"}).alias("status_label"))


# Scores ------------------------------------------------------------------

@query(f"""WITH {SCORED}
SELECT ad_id, {r('roas_norm', 6)} AS roas_norm, {r('ctr_pct_norm', 6)} AS ctr_pct_norm,
       {r('cr_pct_norm', 6)} AS cr_pct_norm, {r('ml_score', 6)} AS ml_score
FROM composite""")
def score_composite(spark, sf_dir):
    names = ["roas_norm", "ctr_pct_norm", "cr_pct_norm", "ml_score"]
    base = stage(campaigns(spark, sf_dir).select("ad_id", "roas", "ctr_pct", "cr_pct"), "campaigns")
    return rounded(composite_score(base).select("ad_id", *names), dict.fromkeys(names, 6))


@query(f"""WITH {SCORED}
SELECT ad_id, priority, {r('ml_score', 6)} AS ml_score FROM prioritised""")
def score_priority(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("ad_id", "priority", "ml_score"), {"ml_score": 6})


@query(f"""WITH {SQUASHED}
SELECT ad_id, {r('conv_score', 6)} AS conv_score FROM squashed""")
def score_sigmoid(spark, sf_dir):
    return rounded(squashed(spark, sf_dir).select("ad_id", "conv_score"), {"conv_score": 6})


@query(f"""WITH {SQUASHED} SELECT ad_id, priority FROM labelled""")
def score_fixed_cut(spark, sf_dir):
    return squashed(spark, sf_dir).select("ad_id", fixed_priority().alias("priority"))


# Filters -----------------------------------------------------------------

@query(f"""WITH {CAMPAIGNS}
SELECT ad_id, advertiser, platform FROM campaigns WHERE target_age = 'BUILDING'""")
def filter_segment(spark, sf_dir):
    return segment(campaigns(spark, sf_dir), "target_age", "BUILDING").select(
        "ad_id", "advertiser", "platform")


@query(f"""WITH {CAMPAIGNS}
SELECT CASE WHEN platform LIKE '%,%' THEN 'multi' ELSE 'single' END AS arm, count(*) AS n,
       CAST(sum(conversions) AS BIGINT) AS conversions
FROM campaigns WHERE platform IS NOT NULL GROUP BY 1""")
def filter_multi_platform(spark, sf_dir):
    arms = campaigns(spark, sf_dir).withColumn("arm", platform_arm()).where("arm is not null")
    return arms.groupBy("arm").agg(
        F.count("*").alias("n"), F.sum("conversions").alias("conversions"))


@query(f"""WITH {CAMPAIGNS}
SELECT ad_id, advertiser, platform FROM campaigns
WHERE advertiser IN ({SQL_ADVERTISERS})
  AND list_has_any(string_split(platform, ','), ['A', 'R'])""")
def filter_selection(spark, sf_dir):
    return selection(campaigns(spark, sf_dir), ADVERTISERS, CHOSEN_PLATFORMS).select(
        "ad_id", "advertiser", "platform")


@query(f"""WITH {FEATURES},
limits AS (SELECT avg(roas) + 3 * stddev_samp(roas) AS a,
                  avg(revenue_per_click) + 3 * stddev_samp(revenue_per_click) AS b FROM feats)
SELECT ad_id, {r('roas', 6)} AS roas, revenue_per_click FROM feats, limits
WHERE roas > a OR revenue_per_click > b""")
def anomaly_3sigma(spark, sf_dir):
    used = features(spark, sf_dir).select("ad_id", "roas", "revenue_per_click")
    return _outliers(stage(used, "features"))


def anomaly_over(df):
    return _outliers(with_features(df).select("ad_id", "roas", "revenue_per_click"))


def _outliers(df):
    return rounded(above_sigma(df, ["roas", "revenue_per_click"]), {"roas": 6})


# Joins and ordered results -----------------------------------------------

@query(f"""WITH {CAMPAIGNS},
dim AS (SELECT platform, avg(roas) AS platform_avg_roas FROM campaigns GROUP BY platform)
SELECT ad_id, platform, {r('platform_avg_roas', 6)} AS platform_avg_roas,
       {r('roas - platform_avg_roas', 6)} AS roas_delta
FROM campaigns JOIN dim USING (platform)""")
def join_platform_delta(spark, sf_dir):
    base = stage(campaigns(spark, sf_dir).select("ad_id", "platform", "roas"), "campaigns")
    return join_over(base)


def join_over(df):
    out = with_group_mean(df.select("ad_id", "platform", "roas"), "platform", "roas",
                          "platform_avg_roas", "roas_delta").drop("roas")
    return rounded(out, {"platform_avg_roas": 6, "roas_delta": 6})


@query(f"""WITH {CAMPAIGNS},
cut AS (SELECT quantile_cont(roas, 0.75) AS q FROM campaigns)
SELECT ad_id, {r('roas', 6)} AS roas, {r('revenue', 2)} AS revenue FROM campaigns, cut
WHERE roas > q ORDER BY campaigns.revenue DESC, ad_id
LIMIT (SELECT least(10000, count(*) // 10) FROM campaigns)""")
def topk_above_q75(spark, sf_dir):
    return topk_over(stage(campaigns(spark, sf_dir).select("ad_id", "roas", "revenue"), "campaigns"))


def topk_over(df):
    top = top_above_quantile(df.select("ad_id", "roas", "revenue"), "roas", 0.75, "revenue", "ad_id")
    return rounded(top, {"roas": 6, "revenue": 2})


def _extreme(spark, sf_dir, level: str, descending: bool) -> DataFrame:
    df = scored(spark, sf_dir, "advertiser", "platform", "conversions")
    score = F.col("ml_score").desc() if descending else F.col("ml_score").asc_nulls_last()
    order = [score, F.col("ad_id").asc()]
    top = with_rank(first_rows(df.where(F.col("priority") == level), order, 20), order)
    return rounded(top.select(
        "position", "ad_id", "advertiser", platform_clean().alias("platform_clean"),
        F.round("ctr_pct", 2).alias("ctr"), F.round("roas", 2).alias("roas"),
        F.round("cr_pct", 2).alias("cr"), "conversions", "ml_score"), {"ml_score": 6})


def _extreme_sql(level: str, direction: str) -> str:
    return f"""WITH {SCORED},
chosen AS (SELECT *, row_number() OVER (ORDER BY ml_score {direction} NULLS LAST, ad_id) AS rn
           FROM prioritised WHERE priority = '{level}')
SELECT CAST(rn AS INTEGER) AS position, ad_id, advertiser,
       CASE WHEN platform LIKE '%,%' THEN 'several' ELSE platform END AS platform_clean,
       {r('ctr_pct', 2)} AS ctr, {r('roas', 2)} AS roas, {r('cr_pct', 2)} AS cr, conversions,
       {r('ml_score', 6)} AS ml_score
FROM chosen WHERE rn <= 20"""


@query(_extreme_sql("HIGH", "DESC"))
def topn_high(spark, sf_dir):
    return _extreme(spark, sf_dir, "HIGH", True)


@query(_extreme_sql("LOW", "ASC"))
def bottomn_low(spark, sf_dir):
    return _extreme(spark, sf_dir, "LOW", False)


# Aggregates --------------------------------------------------------------

@query(f"""WITH {FEATURES}
SELECT count(*) AS n, CAST(sum(high_performer) AS BIGINT) AS positives,
       CAST(count(*) - sum(high_performer) AS BIGINT) AS negatives,
       {r('100e0 * sum(high_performer) / count(*)', 1)} AS pct_positive,
       {r('100e0 * (count(*) - sum(high_performer)) / count(*)', 1)} AS pct_negative
FROM feats""")
def agg_class_balance(spark, sf_dir):
    return kpis.class_balance(features(spark, sf_dir))


@query(f"""WITH {FEATURES}
SELECT advertiser, count(*) AS n, {r('avg(ctr_pct)', 3)} AS ctr, {r('avg(cr_pct)', 3)} AS cr,
       {r('avg(cac)', 0)} AS cac, {r('avg(roas)', 2)} AS roas,
       {r('sum(spent) / 1e6', 1)} AS spend_mln, CAST(sum(high_performer) AS BIGINT) AS high_perf_count
FROM feats GROUP BY advertiser ORDER BY 6 DESC, 1""")
def kpi_advertiser(spark, sf_dir):
    return kpis.advertiser_kpis(features(spark, sf_dir))


@query(f"""WITH {FEATURES}
SELECT target_age, count(*) AS n, {r('avg(ctr_pct)', 3)} AS ctr, {r('avg(cac)', 0)} AS cac,
       {r('avg(roas)', 2)} AS roas, CAST(sum(conversions) AS BIGINT) AS conv,
       {r('100e0 * avg(high_performer)', 1)} AS pct_high_perf
FROM feats GROUP BY target_age ORDER BY 4, 1""")
def kpi_age(spark, sf_dir):
    return kpis.age_kpis(features(spark, sf_dir))


@query(f"""WITH {FEATURES}
SELECT platform, count(*) AS n, {r('avg(ctr_pct)', 3)} AS ctr, {r('avg(roas)', 2)} AS roas,
       {r('100e0 * avg(high_performer)', 1)} AS pct_high_perf
FROM feats GROUP BY platform ORDER BY 4 DESC, 1""")
def kpi_platform(spark, sf_dir):
    """The same report through the SQL view of the features."""
    files.register_view(features(spark, sf_dir), "ads")
    return kpis.platform_kpis(spark.table("ads"))


def _corr_sql(x: str, y: str) -> str:
    return r(f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN corr({y}, {x}) END", 4)


@query(f"""WITH {FEATURES}
SELECT {_corr_sql('impressions', 'conversions')} AS corr_imp_conv,
       {_corr_sql('ctr_pct', 'cr_pct')} AS corr_ctr_cr,
       {_corr_sql('ctr_cr_product', 'roas')} AS corr_ctr_cr_roas,
       {_corr_sql('budget_utilization', 'roas')} AS corr_util_roas,
       {_corr_sql('cost_efficiency', 'high_performer')} AS corr_eff_hp
FROM feats""")
def corr_pairs(spark, sf_dir):
    return kpis.correlations(features(spark, sf_dir))


@query(f"""WITH {SQUASHED}
SELECT priority, count(ad_id) AS campaigns, {r('avg(cac)', 2)} AS avg_cac,
       {r('avg(roas)', 2)} AS avg_roas, {r('avg(conv_score)', 2)} AS avg_score
FROM labelled GROUP BY priority""")
def agg_priority(spark, sf_dir):
    df = squashed(spark, sf_dir, "cac")
    return kpis.priority_summary(df.withColumn("priority", fixed_priority()))


@query(f"""WITH {SQUASHED}
SELECT advertiser, target_age, priority, count(ad_id) AS campaigns, {r('avg(ctr_pct)', 3)} AS avg_ctr,
       {r('avg(cac)', 3)} AS avg_cac, {r('avg(roas)', 3)} AS avg_roas,
       {r('avg(conv_score)', 3)} AS avg_score
FROM labelled GROUP BY advertiser, target_age, priority""")
def agg_report(spark, sf_dir):
    df = squashed(spark, sf_dir, "advertiser", "target_age", "ctr_pct", "cac")
    return kpis.segment_report(df.withColumn("priority", fixed_priority()))


@query(f"""WITH {SCORED}
SELECT advertiser, count(*) FILTER (priority = 'HIGH') AS high,
       count(*) FILTER (priority = 'MEDIUM') AS medium, count(*) FILTER (priority = 'LOW') AS low
FROM prioritised GROUP BY advertiser""")
def pivot_priority(spark, sf_dir):
    wide = kpis.pivot_counts(scored(spark, sf_dir, "advertiser"), "advertiser", "priority", PRIORITIES)
    return wide.select("advertiser", *[F.col(p).alias(p.lower()) for p in PRIORITIES])


@query(f"""WITH {SCORED}
SELECT count(*) FILTER (priority = 'HIGH') AS high, count(*) FILTER (priority = 'MEDIUM') AS medium,
       count(*) FILTER (priority = 'LOW') AS low
FROM prioritised""")
def agg_priority_levels(spark, sf_dir):
    return kpis.priority_levels(scored(spark, sf_dir))


@query(f"""WITH {SCORED}
SELECT advertiser, priority, count(*) AS n FROM prioritised GROUP BY advertiser, priority""")
def agg_adv_priority(spark, sf_dir):
    return kpis.group_size(scored(spark, sf_dir, "advertiser"), "advertiser", "priority")


@query(f"""WITH {CAMPAIGNS}
SELECT {r('sum(impressions) / 1e6', 3)} AS impressions_mln, {r('sum(clicks) / 1e3', 3)} AS clicks_k,
       {r('avg(ctr_pct)', 2)} AS ctr, {r('avg(roas)', 2)} AS roas,
       CAST(sum(conversions) AS BIGINT) AS conversions
FROM campaigns
WHERE advertiser IN ({SQL_ADVERTISERS}) AND list_has_any(string_split(platform, ','), ['A', 'R'])""")
def kpi_bar(spark, sf_dir):
    return kpis.kpi_bar(selection(campaigns(spark, sf_dir), ADVERTISERS, CHOSEN_PLATFORMS))


@query(f"""WITH {CAMPAIGNS}
SELECT advertiser, {r('avg(ctr_pct)', 2)} AS ctr, {r('avg(roas)', 2)} AS roas,
       CAST(round_even(avg(cac), 0) AS BIGINT) AS cac, CAST(sum(conversions) AS BIGINT) AS conversions,
       {r('sum(spent)', 3)} AS spent, CAST(sum(impressions) AS BIGINT) AS impressions
FROM campaigns GROUP BY advertiser ORDER BY avg(roas) DESC, advertiser""")
def kpi_advertiser_display(spark, sf_dir):
    return rounded(kpis.advertiser_display(campaigns(spark, sf_dir)), {"spent": 3})


@query(f"""WITH {CAMPAIGNS}
SELECT advertiser, platform, target_age, CAST(sum(impressions) AS BIGINT) AS total_impressions,
       CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(conversions) AS BIGINT) AS total_conversions,
       {r('sum(spent)', 3)} AS total_spent, {r('avg(ctr_pct)', 6)} AS avg_ctr,
       {r('avg(roas)', 6)} AS avg_roas, count(ad_id) AS campaigns
FROM campaigns GROUP BY advertiser, platform, target_age""")
def bench_groupby(spark, sf_dir):
    return groupby_over(campaigns(spark, sf_dir))


def groupby_over(df):
    return rounded(kpis.three_key_report(df), {"total_spent": 3, "avg_ctr": 6, "avg_roas": 6})


def _pivot_name(platform: str) -> str:
    return "revenue_" + platform.replace(",", "_").lower()


_PIVOT = f"""WITH {CAMPAIGNS}
SELECT advertiser, """ + ", ".join(
    r(f"coalesce(sum(revenue) FILTER (platform = '{p}'), 0)", 2) + f" AS {_pivot_name(p)}"
    for p in PLATFORMS) + ", " + r("coalesce(sum(revenue) FILTER (platform IS NULL OR platform NOT IN ("
    + ", ".join(f"'{p}'" for p in PLATFORMS) + ")), 0)", 2) + " AS revenue_other FROM campaigns GROUP BY advertiser"


@query(_PIVOT)
def pivot_revenue(spark, sf_dir):
    """Revenue per platform, with a column for null and unlisted ones: a row adds up to the advertiser's revenue."""
    return pivot_over(campaigns(spark, sf_dir))


def pivot_over(df):
    wide = kpis.pivot_sum(df, "advertiser", "platform", PLATFORMS, "revenue", other="other")
    return wide.select(
        "advertiser", *[F.round(F.col(f"`{p}`"), 2).alias(_pivot_name(p)) for p in (*PLATFORMS, "other")])


@query(_PIVOT)
def pivot_revenue_whole(spark, sf_dir):
    """The same, from the operator's call."""
    wide = kpis.pivot_sum(campaigns(spark, sf_dir), "advertiser", "platform", PLATFORMS, "revenue", other="other")
    return wide.select(
        "advertiser", *[F.round(F.col(f"`{p}`"), 2).alias(_pivot_name(p)) for p in (*PLATFORMS, "other")])


@query(f"""WITH {CAMPAIGNS},
named AS (SELECT advertiser, coalesce(platform, '(none)') AS platform, revenue FROM campaigns),
top AS (SELECT platform FROM named GROUP BY platform ORDER BY count(*) DESC, platform LIMIT 4)
SELECT advertiser, CASE WHEN platform IN (SELECT platform FROM top) THEN platform ELSE '(other)' END AS platform,
       {r('sum(revenue)', 2)} AS revenue
FROM named GROUP BY 1, 2""")
def pivot_revenue_common(spark, sf_dir):
    """Columns from the data: the four commonest platforms and the rest, as rows again."""
    named = campaigns(spark, sf_dir).select("advertiser", F.coalesce("platform", F.lit("(none)")).alias("platform"), "revenue")
    wide = kpis.pivot_sum_common(stage(named, "named"), "advertiser", "platform", "revenue", 4, "(other)")
    long = wide.unpivot(["advertiser"], [c for c in wide.columns if c != "advertiser"], "platform", "revenue")
    return rounded(long.where(F.col("revenue").isNotNull()), {"revenue": 2})


@query(f"""WITH {CAMPAIGNS}
SELECT p, {r('q', 6)} AS roas FROM (
  SELECT unnest([0.25, 0.5, 0.75, 0.95]) AS p,
         unnest(quantile_cont(roas, [0.25, 0.5, 0.75, 0.95])) AS q FROM campaigns)
""".replace("unnest([0.25, 0.5, 0.75, 0.95]) AS p", "unnest([0.25e0, 0.5e0, 0.75e0, 0.95e0]) AS p"))
def quantile_exact(spark, sf_dir):
    base = stage(campaigns(spark, sf_dir).select("roas"), "campaigns")
    points = [0.25, 0.5, 0.75, 0.95]
    rows = list(zip(points, exact_quantiles(base, "roas", points)))
    return rounded(spark.createDataFrame(rows, "p double, roas double"), {"roas": 6})


@query(f"""WITH {CAMPAIGNS}
SELECT advertiser, count(roas) AS n, {r('quantile_cont(roas, 0.25)', 6)} AS q1,
       {r('quantile_cont(roas, 0.5)', 6)} AS q2, {r('quantile_cont(roas, 0.75)', 6)} AS q3
FROM campaigns GROUP BY advertiser""")
def quantile_grouped(spark, sf_dir):
    base = stage(campaigns(spark, sf_dir).select("advertiser", "roas"), "campaigns")
    out = grouped_quantiles(base, ["advertiser"], "roas", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return rounded(out, {"q1": 6, "q2": 6, "q3": 6})


@query()
def quantile_sketch(spark, sf_dir):
    """Approximate quantile; the rank error is tested against its bound."""
    return campaigns(spark, sf_dir).agg(approximate_quantile("roas", 0.75).alias("q75"))


@query(f"WITH {CAMPAIGNS} SELECT count(roas) AS n, true AS within_bound FROM campaigns")
def quantile_sketch_error(spark, sf_dir):
    """Whether the ranks of the approximate quantile enclose the wanted one within the bound."""
    rows = campaigns(spark, sf_dir)
    q = rows.agg(approximate_quantile("roas", 0.75)).scalar()
    counts = rows.agg(F.count("roas").alias("n"), F.count_if(F.col("roas") < q).alias("below"),
                      F.count_if(F.col("roas") <= q).alias("upto"))
    wanted, slack = 0.75 * F.col("n"), 0.05 * F.col("n")
    return counts.select("n", ((F.col("below") - slack <= wanted) & (wanted <= F.col("upto") + slack)).alias("within_bound"))


@query(f"""WITH {CAMPAIGNS}
SELECT (SELECT count(DISTINCT advertiser) FROM campaigns) AS n_advertiser,
       (SELECT count(DISTINCT platform) FROM campaigns) AS n_platform""")
def agg_distinct(spark, sf_dir):
    return kpis.cardinality(campaigns(spark, sf_dir), "advertiser", "platform")


@query(f"""WITH {CAMPAIGNS} SELECT DISTINCT advertiser FROM campaigns ORDER BY 1""")
def distinct_advertisers(spark, sf_dir):
    return kpis.distinct_values(campaigns(spark, sf_dir), "advertiser")


@query(f"""WITH {CAMPAIGNS}
SELECT DISTINCT unnest(string_split(platform, ',')) AS platform_name FROM campaigns
WHERE platform IS NOT NULL ORDER BY 1""")
def distinct_platforms(spark, sf_dir):
    lists = with_platform_columns(campaigns(spark, sf_dir))
    return kpis.distinct_members(lists, "platform_list", "platform_name")


# Distributions -----------------------------------------------------------

@query(f"""WITH {SCORED},
e AS (SELECT min(ml_score) AS lo, max(ml_score) AS hi FROM composite)
SELECT CAST(least(floor((ml_score - lo) / ((hi - lo) / 40)), 39) + 1 AS INTEGER) AS bin, priority,
       count(*) AS n
FROM prioritised, e WHERE ml_score IS NOT NULL GROUP BY 1, 2""")
def hist_score(spark, sf_dir):
    return histogram(scored(spark, sf_dir), "ml_score", ["priority"], 40)


@query(f"""WITH {CAMPAIGNS},
kept AS (SELECT advertiser, coalesce(platform LIKE '%,%', false) AS is_multi_platform, roas
         FROM campaigns WHERE roas <= (SELECT quantile_cont(roas, 0.95) FROM campaigns)),
box AS (SELECT advertiser, is_multi_platform, count(*) AS n, quantile_cont(roas, 0.25) AS q1,
               quantile_cont(roas, 0.5) AS median, quantile_cont(roas, 0.75) AS q3
        FROM kept GROUP BY 1, 2)
SELECT advertiser, is_multi_platform, any_value(n) AS n, {r('any_value(q1)', 6)} AS q1,
       {r('any_value(median)', 6)} AS median, {r('any_value(q3)', 6)} AS q3,
       {r('min(roas) FILTER (roas >= q1 - 1.5 * (q3 - q1))', 6)} AS whisker_low,
       {r('max(roas) FILTER (roas <= q3 + 1.5 * (q3 - q1))', 6)} AS whisker_high
FROM kept JOIN box USING (advertiser, is_multi_platform) GROUP BY 1, 2""")
def dist_box(spark, sf_dir):
    df = with_platform_columns(campaigns(spark, sf_dir))
    base = stage(df.select("advertiser", "is_multi_platform", "roas"), "campaigns")
    out = box_summary(base, ["advertiser", "is_multi_platform"], "roas", cap=0.95)
    return rounded(out, dict.fromkeys(["q1", "median", "q3", "whisker_low", "whisker_high"], 6))


# The five relational operations of the baseline, over a campaign table that
# has been loaded before.
OPERATIONS = {"groupby": groupby_over, "topk": topk_over, "join": join_over,
              "anomaly": anomaly_over, "pivot": pivot_over}
