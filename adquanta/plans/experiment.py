"""Queries on experiments: tests, intervals, corrections, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adquanta.experiments import bags, report
from adquanta.experiments.bootstrap import (
    MULTIPLIERS,
    PRIME,
    arm_intervals,
    difference_intervals,
    poisson_limits,
    replicate_means,
    replicate_medians,
)
from adquanta.experiments.moments import arm_moments, with_effects
from adquanta.experiments.ranks import rank_statistics
from adquanta.experiments.spec import (
    all_metrics,
    campaign_experiments,
    members,
    ratio_samples,
    samples,
    spec_table,
)
from adquanta.experiments.table_function import arm_rows, register_two_sample_test
from adquanta.functions.features import relabel
from adquanta.functions.labels import effect_text, strength
from adquanta.session import stage
from adquanta.sources.tables import campaigns

from .common import CAMPAIGNS, r, registry, rounded

QUERIES, SQL, query = registry()

# Segments of the supplied tables that stand in for the standard comparisons.
SPECS = campaign_experiments("BUILDING", "MACHINERY", "A", "N", "NATION_7", "NATION_8")
REPLICATES = 2000
COLUMNS = ["ad_id", "advertiser", "platform", "target_age", *all_metrics(SPECS)]


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(campaigns(spark, sf_dir).select(*COLUMNS), "campaigns")


def member_rows(spark: SparkSession, sf_dir: str, ranges: bool = False) -> DataFrame:
    return members(staged(spark, sf_dir), SPECS, "ad_id", ranges)


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and effects need one pass, so nothing is staged."""
    base = campaigns(spark, sf_dir).select(*COLUMNS)
    return with_effects(arm_moments(samples(members(base, SPECS), SPECS), report.KEYS))


# Check SQL ---------------------------------------------------------------

# Experiment, metrics, predicate a, predicate b, label a, label b.
_PLAIN = [
    ("age", ["ctr_pct", "cr_pct", "roas", "cac"], "target_age = 'BUILDING'",
     "target_age = 'MACHINERY'", "BUILDING", "MACHINERY"),
    ("platform", ["ctr_pct", "roas", "cr_pct"], "platform = 'A'", "platform = 'N'", "A", "N"),
    ("multi_platform", ["ctr_pct", "roas", "conversions"], "platform NOT LIKE '%,%'",
     "platform LIKE '%,%'", "single", "multi"),
    ("advertiser", ["ctr_pct", "cr_pct", "roas", "cac"], "advertiser = 'NATION_7'",
     "advertiser = 'NATION_8'", "NATION_7", "NATION_8"),
]

LONG = CAMPAIGNS + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS experiment, '{m}' AS metric, '{arm}' AS arm, "
    f"CAST(ad_id AS VARCHAR) AS row_id, CAST({m} AS DOUBLE) AS value "
    f"FROM campaigns WHERE {where} AND {m} IS NOT NULL"
    for name, metrics, where_a, where_b, _, _ in _PLAIN for m in metrics
    for arm, where in (("a", where_a), ("b", where_b))) + ")"

NAMED = ", named AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{m}', '{a}', '{b}')" for name, metrics, _, _, a, b in _PLAIN for m in metrics
) + ") v(experiment, metric, group_a, group_b))"

MOMENTS = LONG + """,
mom AS (
  SELECT experiment, metric,
         count(*) FILTER (arm = 'a') AS n_a, avg(value) FILTER (arm = 'a') AS mean_a,
         stddev_samp(value) FILTER (arm = 'a') AS std_a,
         quantile_cont(value, 0.5) FILTER (arm = 'a') AS median_a,
         count(*) FILTER (arm = 'b') AS n_b, avg(value) FILTER (arm = 'b') AS mean_b,
         stddev_samp(value) FILTER (arm = 'b') AS std_b,
         quantile_cont(value, 0.5) FILTER (arm = 'b') AS median_b
  FROM long GROUP BY 1, 2
),
eff AS (
  SELECT *, (mean_b - mean_a) / mean_a * 100 AS lift_pct,
         (mean_a - mean_b)
           / sqrt(((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / (n_a + n_b - 2)) AS cohens_d,
         (mean_a - mean_b) / sqrt(std_a * std_a / n_a + std_b * std_b / n_b) AS t_statistic,
         pow(std_a * std_a / n_a + std_b * std_b / n_b, 2)
           / (pow(std_a * std_a / n_a, 2) / (n_a - 1) + pow(std_b * std_b / n_b, 2) / (n_b - 1)) AS welch_df
  FROM mom
)"""

RANKS = """,
ranked AS (
  SELECT *, rank() OVER (PARTITION BY experiment, metric ORDER BY value)
            + (count(*) OVER (PARTITION BY experiment, metric, value) - 1) / 2e0 AS mid_rank,
         count(*) OVER (PARTITION BY experiment, metric, value) AS t
  FROM long
),
u0 AS (
  SELECT experiment, metric, sum(mid_rank) FILTER (arm = 'a') AS rank_sum,
         CAST(count(*) FILTER (arm = 'a') AS DOUBLE) AS na, CAST(count(*) FILTER (arm = 'b') AS DOUBLE) AS nb,
         sum(CAST(t AS DOUBLE) * t - 1) AS tie_term
  FROM ranked GROUP BY 1, 2
),
u1 AS (
  SELECT *, rank_sum - na * (na + 1) / 2 AS u_statistic FROM u0
),
u2 AS (
  SELECT *, (greatest(u_statistic, na * nb - u_statistic) - na * nb / 2 - 0.5)
            / sqrt(na * nb / 12 * (na + nb + 1 - tie_term / ((na + nb) * (na + nb - 1)))) AS u_z
  FROM u1
)"""

# Both tails by Simpson's rule: for t with the angle as variable, for the
# normal over twelve deviations beyond z.
P_VALUES = """,
steps AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
          FROM range(4001) s(i)),
p_t AS (
  SELECT experiment, metric,
         sum(w * 2 * exp(lgamma((welch_df + 1) / 2) - lgamma(welch_df / 2)) / sqrt(pi())
             * pow(cos(a0 + i * h), welch_df - 1)) * any_value(h) / 3 AS p_value_ttest
  FROM (SELECT experiment, metric, welch_df, a0, least(pi() / 2 - a0, 15 / sqrt(welch_df)) / 4000 AS h
        FROM (SELECT experiment, metric, welch_df, atan(abs(t_statistic) / sqrt(welch_df)) AS a0 FROM eff)),
       steps
  GROUP BY 1, 2
),
p_u AS (
  SELECT experiment, metric,
         sum(w * 2 / sqrt(2 * pi()) * exp(-pow(u_z + i * 12e0 / 4000, 2) / 2)) * (12e0 / 4000) / 3 AS p_value_mwu
  FROM u2, steps GROUP BY 1, 2
)"""

_LIMITS = poisson_limits()
# Each replicate is a step of two multiplicative generators; weights count the
# Poisson limits at or below the resulting number.
DRAWN = f""",
rep AS (
  WITH RECURSIVE steps_of(replicate, p, q) AS (
    SELECT 0, CAST({MULTIPLIERS[0]} AS BIGINT), CAST({MULTIPLIERS[1]} AS BIGINT)
    UNION ALL
    SELECT replicate + 1, p * {MULTIPLIERS[0]} % {PRIME}, q * {MULTIPLIERS[1]} % {PRIME}
    FROM steps_of WHERE replicate + 1 < {REPLICATES}
  ) SELECT * FROM steps_of
),
ids AS (
  SELECT DISTINCT row_id, CAST('0x' || substr(md5(row_id), 1, 7) AS BIGINT) + 1 AS x,
         CAST('0x' || substr(md5(row_id), 8, 7) AS BIGINT) + 1 AS y FROM long
),
weights AS (
  SELECT row_id, replicate, {" + ".join(f"CAST(u >= {k} AS INTEGER)" for k in _LIMITS)} AS weight
  FROM (SELECT row_id, replicate, (x * p + y * q) % {PRIME} AS u FROM ids, rep)
)"""

REP_MEANS = DRAWN + """,
stats AS (
  SELECT experiment, metric, arm, replicate, sum(weight * value) / sum(weight) AS stat
  FROM long JOIN weights USING (row_id) WHERE weight > 0 GROUP BY 1, 2, 3, 4
)"""

CI = """,
ci AS (
  SELECT experiment, metric, quantile_cont(d, 0.025) AS ci_lower, quantile_cont(d, 0.975) AS ci_upper,
         quantile_cont(a, 0.025) AS ci_a_lower, quantile_cont(a, 0.975) AS ci_a_upper,
         quantile_cont(b, 0.025) AS ci_b_lower, quantile_cont(b, 0.975) AS ci_b_upper
  FROM (SELECT experiment, metric, replicate, max(stat) FILTER (arm = 'a') AS a,
               max(stat) FILTER (arm = 'b') AS b, b - a AS d
        FROM stats GROUP BY 1, 2, 3)
  GROUP BY 1, 2
)"""

EFFECT = """CASE WHEN cohens_d IS NULL THEN '-' WHEN abs(cohens_d) < 0.2 THEN 'negligible'
     WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END"""
SHORT = """CASE WHEN abs(cohens_d) < 0.2 THEN 'negl.' WHEN abs(cohens_d) < 0.5 THEN 'small'
     WHEN abs(cohens_d) < 0.8 THEN 'med.' ELSE 'large' END"""


# Tests -------------------------------------------------------------------

@query(f"""WITH {MOMENTS}
SELECT experiment, metric, n_a, n_b, {r('mean_a', 4)} AS mean_a, {r('mean_b', 4)} AS mean_b,
       {r('median_a', 4)} AS median_a, {r('median_b', 4)} AS median_b,
       {r('std_a', 4)} AS std_a, {r('std_b', 4)} AS std_b FROM mom""")
def ab_describe(spark, sf_dir):
    long = samples(member_rows(spark, sf_dir, ranges=True), SPECS)
    moments = arm_moments(long, report.KEYS)
    medians = rank_statistics(long, report.KEYS).select(*report.KEYS, "median_a", "median_b")
    names = [f"{m}_{s}" for m in ("mean", "median", "std") for s in "ab"]
    return rounded(moments.join(medians, report.KEYS), dict.fromkeys(names, 4))


@query(f"""WITH {MOMENTS}
SELECT experiment, metric, {r('lift_pct', 4)} AS lift_pct, {r('cohens_d', 6)} AS cohens_d,
       {EFFECT} AS effect_size, printf('d=%.2f %s', cohens_d, {SHORT}) AS d_label FROM eff""")
def ab_effect(spark, sf_dir):
    out = effects(spark, sf_dir).select(
        *report.KEYS, "lift_pct", "cohens_d", "effect_size", effect_text("cohens_d").alias("d_label"))
    return rounded(out, {"lift_pct": 4, "cohens_d": 6})


@query(f"""WITH {MOMENTS}
SELECT experiment, metric, {r('t_statistic', 6)} AS t_statistic, {r('welch_df', 4)} AS welch_df FROM eff""")
def ab_welch(spark, sf_dir):
    return rounded(effects(spark, sf_dir).select(*report.KEYS, "t_statistic", "welch_df"),
                   {"t_statistic": 6, "welch_df": 4})


@query(f"""WITH {MOMENTS}{P_VALUES.split(",\np_u AS")[0]}
SELECT experiment, metric, n_a, n_b, {r('mean_a', 4)} AS mean_a, {r('mean_b', 4)} AS mean_b,
       {r('cohens_d', 6)} AS cohens_d, {r('t_statistic', 6)} AS t_statistic, {r('welch_df', 4)} AS welch_df,
       {r('p_value_ttest', 5)} AS p_value, p_value_ttest < 0.05 AS significant
FROM eff JOIN p_t USING (experiment, metric)""")
def ab_table_function(spark, sf_dir):
    """Welch's test of all hypotheses, called from SQL as a table function."""
    register_two_sample_test(spark)
    base = campaigns(spark, sf_dir).select(*COLUMNS)
    arms = arm_rows(samples(members(base, SPECS), SPECS), report.KEYS)
    out = spark.sql("SELECT * FROM two_sample_test(TABLE({arms}), 0.05)", arms=arms)
    return rounded(out, {"mean_a": 4, "mean_b": 4, "cohens_d": 6, "t_statistic": 6, "welch_df": 4, "p_value": 5})


@query(f"""WITH {MOMENTS}{RANKS}
SELECT experiment, metric, {r('u_statistic', 1)} AS u_statistic, {r('tie_term', 0)} AS tie_term,
       {r('u_z', 6)} AS u_z FROM u2""")
def ab_mannwhitney(spark, sf_dir):
    long = samples(member_rows(spark, sf_dir, ranges=True), SPECS)
    out = rank_statistics(long, report.KEYS).select(*report.KEYS, "u_statistic", "tie_term", "u_z")
    return rounded(out, {"u_statistic": 1, "tie_term": 0, "u_z": 6})


@query(f"""WITH {MOMENTS}{RANKS}{P_VALUES}
SELECT experiment, metric, {r('p_value_ttest', 5)} AS p_value_ttest, {r('p_value_mwu', 5)} AS p_value_mwu
FROM p_t JOIN p_u USING (experiment, metric)""")
def ab_pvalue(spark, sf_dir):
    tests = report.hypothesis_statistics(member_rows(spark, sf_dir, ranges=True), SPECS)
    out = report.with_significance(tests).select(*report.KEYS, "p_value_ttest", "p_value_mwu")
    return rounded(out, {"p_value_ttest": 5, "p_value_mwu": 5})


@query(f"""WITH {MOMENTS}{RANKS}{P_VALUES}
SELECT experiment, metric, {r('-log10(greatest(round(p_value_ttest, 4), 1e-10))', 4)} AS signif_log
FROM p_t""")
def ab_strength(spark, sf_dir):
    """Strength of significance from p-values rounded to 4 places."""
    tests = report.with_significance(
        report.hypothesis_statistics(member_rows(spark, sf_dir, ranges=True), SPECS))
    return rounded(tests.select(
        *report.KEYS, strength(F.round("p_value_ttest", 4)).alias("signif_log")), {"signif_log": 4})


@query(f"""WITH {MOMENTS}{NAMED}{RANKS}{P_VALUES}
SELECT experiment, metric, CASE WHEN mean_b > mean_a THEN group_b ELSE group_a END AS winner,
       CASE WHEN mean_b > mean_a THEN group_a ELSE group_b END AS loser,
       CASE WHEN mean_b > mean_a THEN 'up' ELSE 'down' END AS direction,
       p_value_ttest < 0.05 AS significant_ttest, p_value_mwu < 0.05 AS significant_mwu,
       p_value_ttest < 0.05 AND p_value_mwu < 0.05 AS significant_both,
       CASE metric WHEN 'ctr_pct' THEN 'CTR' WHEN 'cr_pct' THEN 'CR' WHEN 'roas' THEN 'ROAS'
                   WHEN 'cac' THEN 'CAC' ELSE metric END AS metric_label
FROM eff JOIN named USING (experiment, metric) JOIN p_t USING (experiment, metric)
JOIN p_u USING (experiment, metric)""")
def ab_verdict(spark, sf_dir):
    rows = member_rows(spark, sf_dir, ranges=True)
    tests = report.with_significance(report.hypothesis_statistics(rows, SPECS))
    named = spec_table(rows, SPECS).join(tests, report.KEYS)
    return report.with_verdict(named).select(
        *report.KEYS, "winner", "loser", "direction", "significant_ttest", "significant_mwu",
        "significant_both", relabel("metric", report.METRIC_LABELS).alias("metric_label"))


@query(f"""WITH {MOMENTS}{NAMED}{RANKS}{P_VALUES}
SELECT experiment, metric, CASE WHEN mean_b > mean_a THEN group_b ELSE group_a END AS winner,
       CASE WHEN mean_b > mean_a THEN group_a ELSE group_b END AS loser,
       {r('abs(lift_pct)', 1)} AS lift_pct
FROM eff JOIN named USING (experiment, metric) JOIN p_t USING (experiment, metric)
JOIN p_u USING (experiment, metric)
WHERE p_value_ttest < 0.05 AND p_value_mwu < 0.05""")
def ab_significant(spark, sf_dir):
    """Only the hypotheses that both tests support, as the summary lists them."""
    rows = member_rows(spark, sf_dir, ranges=True)
    tests = report.with_significance(report.hypothesis_statistics(rows, SPECS))
    named = spec_table(rows, SPECS).join(tests.where("significant_both"), report.KEYS)
    return report.with_verdict(named).select(
        *report.KEYS, "winner", "loser", F.round(F.abs("lift_pct"), 1).alias("lift_pct"))


@query(f"""WITH {MOMENTS}{RANKS}{P_VALUES},
b AS (SELECT *, 0.05e0 / count(*) OVER (PARTITION BY experiment) AS a FROM p_t)
SELECT experiment, metric, {r('a', 6)} AS bonferroni_alpha, p_value_ttest < a AS significant_bonferroni,
       count(*) FILTER (p_value_ttest < a) OVER (PARTITION BY experiment) AS n_significant_bonferroni
FROM b""")
def ab_bonferroni(spark, sf_dir):
    tests = report.hypothesis_statistics(member_rows(spark, sf_dir, ranges=True), SPECS)
    out = report.with_bonferroni(report.with_significance(tests))
    return rounded(out.select(*report.KEYS, "bonferroni_alpha", "significant_bonferroni",
                              "n_significant_bonferroni"), {"bonferroni_alpha": 6})


@query(f"""WITH {MOMENTS}{NAMED}{RANKS}{P_VALUES}{REP_MEANS}{CI}
SELECT experiment, metric, group_a, group_b, n_a, n_b, {r('mean_a', 4)} AS mean_a,
       {r('mean_b', 4)} AS mean_b, {r('median_a', 4)} AS median_a, {r('median_b', 4)} AS median_b,
       {r('std_a', 4)} AS std_a, {r('std_b', 4)} AS std_b, {r('lift_pct', 4)} AS lift_pct,
       {r('t_statistic', 6)} AS t_statistic, {r('p_value_ttest', 5)} AS p_value_ttest,
       {r('u_statistic', 1)} AS u_statistic, {r('p_value_mwu', 5)} AS p_value_mwu,
       {r('cohens_d', 6)} AS cohens_d, {EFFECT} AS effect_size,
       {r('ci_lower', 5)} AS ci_lower, {r('ci_upper', 5)} AS ci_upper,
       ci_lower > 0 OR ci_upper < 0 AS ci_excludes_zero,
       {r('ci_a_lower', 4)} AS ci_a_lower, {r('ci_a_upper', 4)} AS ci_a_upper,
       {r('ci_b_lower', 4)} AS ci_b_lower, {r('ci_b_upper', 4)} AS ci_b_upper,
       p_value_ttest < 0.05 AS significant_ttest, p_value_mwu < 0.05 AS significant_mwu,
       p_value_ttest < 0.05 AND p_value_mwu < 0.05 AS significant_both
FROM eff JOIN named USING (experiment, metric) JOIN u2 USING (experiment, metric)
JOIN p_t USING (experiment, metric) JOIN p_u USING (experiment, metric)
JOIN ci USING (experiment, metric)""")
def ab_all(spark, sf_dir):
    """The full record of all 14 hypotheses."""
    out = report.run_experiments(staged(spark, sf_dir), SPECS, replicates=REPLICATES)
    ends = {f"{ci}_{end}": F.col(ci)[i] for ci in ("ci_a", "ci_b")
            for i, end in enumerate(("lower", "upper"))}
    out = out.withColumns(ends).drop("ci_a", "ci_b", "test_no", "welch_df", "tie_term", "u_z")
    four = ["mean_a", "mean_b", "median_a", "median_b", "std_a", "std_b", "lift_pct", *ends]
    return rounded(out, {
        **dict.fromkeys(four, 4), **dict.fromkeys(["t_statistic", "cohens_d"], 6), "u_statistic": 1,
        **dict.fromkeys(["p_value_ttest", "p_value_mwu", "ci_lower", "ci_upper"], 5)})


@query(f"""WITH {MOMENTS}{RANKS}{P_VALUES}
SELECT count(*) AS n_tests, count(*) FILTER (p_value_ttest < 0.05 AND p_value_mwu < 0.05) AS n_significant,
       count(*) FILTER (NOT (p_value_ttest < 0.05 AND p_value_mwu < 0.05)) AS n_not_significant,
       {r('0.05e0 / count(*)', 4)} AS family_alpha
FROM p_t JOIN p_u USING (experiment, metric)""")
def ab_totals(spark, sf_dir):
    tests = report.hypothesis_statistics(member_rows(spark, sf_dir, ranges=True), SPECS)
    return report.totals(report.with_significance(tests))


@query()
def ab_report(spark, sf_dir):
    """The nested report document."""
    return report.nested_report(
        report.run_experiments(staged(spark, sf_dir), SPECS, replicates=REPLICATES))


@query(f"""WITH {MOMENTS}{NAMED}{RANKS}{P_VALUES}{REP_MEANS}{CI},
t AS (SELECT count(*) AS n, count(*) FILTER (p_value_ttest < 0.05 AND p_value_mwu < 0.05) AS hits
      FROM p_t JOIN p_u USING (experiment, metric))
SELECT n AS total_hypotheses, hits AS significant_hypotheses, {r('0.05e0 / n', 4)} AS bonferroni_alpha,
       group_a || ' vs ' || group_b AS name, metric, {r('mean_a', 4)} AS mean_a, {r('mean_b', 4)} AS mean_b,
       {r('lift_pct', 2)} AS lift_pct, {r('p_value_ttest', 4)} AS p_value_ttest,
       {r('p_value_mwu', 4)} AS p_value_mwu, {r('cohens_d', 4)} AS cohens_d, {EFFECT} AS effect_size,
       p_value_ttest < 0.05 AND p_value_mwu < 0.05 AS significant,
       {r('ci_lower', 4)} AS ci_lower, {r('ci_upper', 4)} AS ci_upper
FROM t, eff JOIN named USING (experiment, metric) JOIN p_t USING (experiment, metric)
JOIN p_u USING (experiment, metric) JOIN ci USING (experiment, metric)""")
def ab_report_fields(spark, sf_dir):
    """The fields of the nested report document, a row for each test in it."""
    doc = ab_report(spark, sf_dir)
    flat = doc.select("total_hypotheses", "significant_hypotheses", "bonferroni_alpha", F.inline("experiments"))
    return flat.withColumns({"ci_lower": F.col("ci_95")[0], "ci_upper": F.col("ci_95")[1]}).drop("test_no", "ci_95")


# Per advertiser ----------------------------------------------------------

_BY_ADVERTISER = CAMPAIGNS + """,
long AS (
  SELECT advertiser, metric, CASE WHEN platform LIKE '%,%' THEN 'b' ELSE 'a' END AS arm, value
  FROM (SELECT advertiser, platform, 'roas' AS metric, roas AS value FROM campaigns
        UNION ALL SELECT advertiser, platform, 'ctr_pct', ctr_pct FROM campaigns
        UNION ALL SELECT advertiser, platform, 'conversions', conversions FROM campaigns)
  WHERE value IS NOT NULL
),
mom AS (
  SELECT advertiser AS experiment, metric,
         count(*) FILTER (arm = 'a') AS n_a, avg(value) FILTER (arm = 'a') AS mean_a,
         var_samp(value) FILTER (arm = 'a') AS v_a,
         count(*) FILTER (arm = 'b') AS n_b, avg(value) FILTER (arm = 'b') AS mean_b,
         var_samp(value) FILTER (arm = 'b') AS v_b
  FROM long GROUP BY 1, 2
),
eff AS (
  SELECT *, (mean_a - mean_b)
           / (sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) + 1e-9) AS cohens_d,
         (mean_a - mean_b) / sqrt(v_a / n_a + v_b / n_b) AS t_statistic,
         pow(v_a / n_a + v_b / n_b, 2)
           / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)) AS welch_df
  FROM mom WHERE n_a >= 2 AND n_b >= 2
)"""
_P_T_ONLY = P_VALUES.split(",\np_u AS")[0]


@query(f"""WITH {_BY_ADVERTISER}{_P_T_ONLY}
SELECT experiment AS advertiser, metric,
       CASE WHEN metric = 'conversions' THEN round_even(mean_a, 0) ELSE {r('mean_a', 2)} END AS mean_a,
       CASE WHEN metric = 'conversions' THEN round_even(mean_b, 0) ELSE {r('mean_b', 2)} END AS mean_b,
       n_a, n_b, {r('t_statistic', 3)} AS t_statistic, {r('p_value_ttest', 4)} AS p_value,
       {r('cohens_d', 3)} AS cohens_d, {EFFECT} AS effect_size, least(n_a, n_b) <= 3 AS small_sample,
       p_value_ttest < 0.05 AS significant,
       {r('-log10(greatest(' + r('p_value_ttest', 4) + ', 1e-10))', 4)} AS signif_log,
       printf('d=%.2f %s', {r(r('cohens_d', 3), 2)}, {SHORT.replace('cohens_d', r('cohens_d', 3))}) AS d_label
FROM eff JOIN p_t USING (experiment, metric) ORDER BY 1, 2""")
def ab_by_advertiser(spark, sf_dir):
    """Single against multi-platform campaigns of each advertiser."""
    base = campaigns(spark, sf_dir).select("advertiser", "platform", "roas", "ctr_pct", "conversions")
    table = report.advertiser_table(report.advertiser_tests(base))
    return rounded(table, {"signif_log": 4}).orderBy("advertiser", "metric")


# Intervals ---------------------------------------------------------------

@query(f"""WITH {LONG}{REP_MEANS}
SELECT experiment, metric, arm, {r('quantile_cont(stat, 0.025)', 5)} AS lower,
       {r('quantile_cont(stat, 0.975)', 5)} AS upper
FROM stats GROUP BY 1, 2, 3""")
def boot_mean_ci(spark, sf_dir):
    stats = replicate_means(member_rows(spark, sf_dir), SPECS, REPLICATES)
    return rounded(_ends(arm_intervals(stats)), {"lower": 5, "upper": 5})


@query(f"""WITH {LONG}{REP_MEANS}{CI}
SELECT experiment, metric, {r('ci_lower', 5)} AS ci_lower, {r('ci_upper', 5)} AS ci_upper,
       ci_lower > 0 OR ci_upper < 0 AS ci_excludes_zero FROM ci""")
def boot_diff_ci(spark, sf_dir):
    stats = replicate_means(member_rows(spark, sf_dir), SPECS, REPLICATES)
    out = difference_intervals(stats).drop("ci_a", "ci_b")
    return rounded(out, {"ci_lower": 5, "ci_upper": 5})


@query(f"""WITH {LONG}{DRAWN},
runs AS (
  SELECT experiment, metric, arm, replicate, value,
         sum(weight) OVER (PARTITION BY experiment, metric, arm, replicate ORDER BY value, row_id
                           ROWS UNBOUNDED PRECEDING) AS upto, weight,
         (sum(weight) OVER (PARTITION BY experiment, metric, arm, replicate) - 1) / 2e0 AS middle
  FROM long JOIN weights USING (row_id) WHERE weight > 0
),
stats AS (
  SELECT experiment, metric, arm, replicate,
         (max(value) FILTER (upto - weight <= floor(middle) AND floor(middle) < upto)
          + max(value) FILTER (upto - weight <= ceil(middle) AND ceil(middle) < upto)) / 2 AS stat
  FROM runs GROUP BY 1, 2, 3, 4)
SELECT experiment, metric, arm, {r('quantile_cont(stat, 0.025)', 6)} AS lower,
       {r('quantile_cont(stat, 0.975)', 6)} AS upper
FROM stats GROUP BY 1, 2, 3""")
def boot_median_ci(spark, sf_dir):
    """Median in place of the mean, for all hypotheses."""
    long = samples(member_rows(spark, sf_dir), SPECS)
    return rounded(_ends(arm_intervals(replicate_medians(long, REPLICATES))), {"lower": 6, "upper": 6})


# The sums behind the metrics, top and bottom.
_SUMS = {"ctr_pct": ("100e0 * clicks", "impressions"), "cr_pct": ("100e0 * conversions", "clicks"),
         "roas": ("revenue", "spent"), "cac": ("spent", "conversions"), "conversions": ("conversions", "1")}
_PARTS = CAMPAIGNS + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS experiment, '{m}' AS metric, '{arm}' AS arm, CAST(ad_id AS VARCHAR) AS row_id, "
    f"CAST({_SUMS[m][0]} AS DOUBLE) AS top, CAST({_SUMS[m][1]} AS DOUBLE) AS bottom "
    f"FROM campaigns WHERE {where} AND {_SUMS[m][0]} IS NOT NULL AND {_SUMS[m][1]} IS NOT NULL"
    for name, metrics, where_a, where_b, _, _ in _PLAIN for m in metrics
    for arm, where in (("a", where_a), ("b", where_b))) + ")"

# Rows of a bag with their weights in each replicate: the Poisson limits at or below a number.
_BAGS = f""",
rep AS (
  WITH RECURSIVE steps_of(replicate, p, q) AS (
    SELECT 0, CAST({MULTIPLIERS[0]} AS BIGINT), CAST({MULTIPLIERS[1]} AS BIGINT)
    UNION ALL
    SELECT replicate + 1, p * {MULTIPLIERS[0]} % {PRIME}, q * {MULTIPLIERS[1]} % {PRIME}
    FROM steps_of WHERE replicate + 1 < {bags.REPLICATES}
  ) SELECT * FROM steps_of
),
dealt AS (
  SELECT *, CAST('0x' || substr(md5(row_id), 1, 7) AS BIGINT) + 1 AS x,
         CAST('0x' || substr(md5(row_id), 8, 7) AS BIGINT) + 1 AS y,
         CAST('0x' || substr(md5(row_id), 15, 7) AS BIGINT) % CAST(ceil(n / {bags.BAG_ROWS}e0) AS BIGINT) AS bag
  FROM (SELECT *, count(*) OVER (PARTITION BY experiment, metric, arm) AS n FROM long)
),
means AS (
  SELECT experiment, metric, arm, bag, any_value(n) / CAST(count(*) AS DOUBLE) AS mean
  FROM dealt GROUP BY 1, 2, 3, 4
),
places AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil(mean - 12 * sqrt(mean) - 20)) AS BIGINT),
                         CAST(ceil(mean + 12 * sqrt(mean) + 20) AS BIGINT) + 1)) AS k FROM means
),
limits AS (
  SELECT experiment, metric, arm, bag, min(k) AS low, list(below ORDER BY k) AS below
  FROM (SELECT *, CAST(floor({PRIME} * sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (
          PARTITION BY experiment, metric, arm, bag ORDER BY k ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS below
        FROM places)
  GROUP BY 1, 2, 3, 4
),
runs AS (
  SELECT d.*, replicate, low + len(list_filter(below, lambda z: z <= (x * p + y * q) % {PRIME})) AS weight
  FROM dealt d JOIN limits USING (experiment, metric, arm, bag), rep
)"""
_BAG_ENDS = f"""
SELECT experiment, metric, arm, {r('avg(lower)', 6)} AS lower, {r('avg(upper)', 6)} AS upper, count(*) AS bags
FROM (SELECT experiment, metric, arm, bag, quantile_cont(stat, 0.025) AS lower, quantile_cont(stat, 0.975) AS upper
      FROM stats GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2, 3"""
_ARM = [*report.KEYS, "arm"]


@query(f"""WITH {LONG}{_BAGS},
sorted AS (
  SELECT *, sum(weight) OVER (PARTITION BY experiment, metric, arm, bag, replicate ORDER BY value, row_id
                              ROWS UNBOUNDED PRECEDING) AS upto,
         sum(weight) OVER (PARTITION BY experiment, metric, arm, bag, replicate) AS total FROM runs
),
stats AS (
  SELECT experiment, metric, arm, bag, replicate, sum(value * kept) / sum(kept) AS stat
  FROM (SELECT *, greatest(0, least(upto, 0.9e0 * total) - greatest(upto - weight, 0.1e0 * total)) AS kept FROM sorted)
  GROUP BY 1, 2, 3, 4, 5
){_BAG_ENDS}""")
def boot_trimmed_ci(spark, sf_dir):
    """Intervals of the mean without a tenth at either end, from a bag of little bootstraps."""
    long = samples(member_rows(spark, sf_dir), SPECS)
    stats = bags.bag_statistics(long, _ARM, ["value"], bags.trimmed_mean())
    return rounded(bags.bag_intervals(stats, _ARM), {"lower": 6, "upper": 6})


@query(f"""WITH {_PARTS}{_BAGS},
stats AS (
  SELECT experiment, metric, arm, bag, replicate, sum(weight * top) / nullif(sum(weight * bottom), 0) AS stat
  FROM runs GROUP BY 1, 2, 3, 4, 5
){_BAG_ENDS}""")
def boot_ratio_ci(spark, sf_dir):
    """Intervals of the metrics of whole segments, ratios of sums, in the same way."""
    base = stage(campaigns(spark, sf_dir).select(
        *COLUMNS, "clicks", "impressions", "revenue", "spent"), "campaigns")
    stats = bags.bag_statistics(ratio_samples(base, SPECS), _ARM, ["top", "bottom"], bags.ratio_of_sums)
    return rounded(bags.bag_intervals(stats, _ARM), {"lower": 6, "upper": 6})


def _ends(intervals: DataFrame) -> DataFrame:
    return intervals.select("experiment", "metric", "arm", F.col("ci")[0].alias("lower"),
                            F.col("ci")[1].alias("upper"))
