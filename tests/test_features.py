import math

import pytest
from pyspark.sql import functions as F

from adquanta.functions.features import relabel, with_features, with_platform_columns
from adquanta.functions.labels import effect_label, effect_text, priority, strength
from adquanta.functions.safe import pearson, ratio_or_zero

COLUMNS = ("ad_id string, platform string, duration_days int, impressions long, clicks long, "
           "ctr_pct double, cr_pct double, spent double, cac double, revenue double, roas double, "
           "budget double")
ROWS = [
    ("plain", "Facebook", 10, 1000, 50, 5.0, 2.0, 100.0, 7.0, 600.0, 6.0, 200.0),
    ("zero_budget", "Facebook", 10, 1000, 50, 5.0, 2.0, 100.0, 7.0, 600.0, 6.0, 0.0),
    ("zero_days", "Facebook", 0, 1000, 50, 5.0, 2.0, 100.0, 7.0, 600.0, 6.0, 200.0),
    ("zero_clicks", "Facebook", 10, 1000, 0, 0.0, 2.0, 100.0, None, 600.0, 6.0, 200.0),
    ("null_roas", "Facebook", 10, 1000, 50, 5.0, 2.0, 0.0, 7.0, 600.0, None, 200.0),
    ("nan_roas", "Facebook", 10, 1000, 50, 5.0, 2.0, 100.0, 7.0, 600.0, math.nan, 200.0),
    ("several", " Facebook , Instagram", 10, 1000, 50, 5.0, 2.0, 100.0, 7.0, 600.0, 6.0, 200.0),
    ("no_platform", None, 10, 1000, 50, 5.0, 2.0, 100.0, 7.0, 600.0, 6.0, 200.0),
    ("at_threshold", "Facebook", 10, 1000, 50, 5.0, 2.0, 100.0, 7.0, 500.0, 5.0, 200.0),
]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def features(tiny):
    return {r.ad_id: r for r in with_features(tiny).collect()}


def test_plain_row(features):
    r = features["plain"]
    assert (r.high_performer, r.budget_utilization, r.clicks_per_day) == (1, 0.5, 5.0)
    assert (r.spend_per_impression, r.revenue_per_click, r.is_multi_platform) == (0.1, 12.0, 0)
    assert (r.ctr_cr_product, r.cost_efficiency) == (10.0, 6.0)


def test_zero_denominators_and_fill(features):
    assert features["zero_budget"].budget_utilization is None
    assert features["zero_days"].clicks_per_day is None
    assert features["zero_clicks"].revenue_per_click == 0.0
    assert features["zero_clicks"].cac == 0.0
    assert features["null_roas"].cost_efficiency == 0.0


def test_threshold_is_strict_and_missing_is_low(features):
    assert features["at_threshold"].high_performer == 0
    assert features["null_roas"].high_performer == 0
    assert features["nan_roas"].high_performer == 0


def test_platform_columns(tiny):
    rows = {r.ad_id: r for r in with_platform_columns(tiny).collect()}
    assert rows["several"].platform_list == ["Facebook", "Instagram"]
    assert rows["several"].is_multi_platform and rows["several"].platform_clean == "several"
    assert rows["plain"].platform_clean == "Facebook"
    assert rows["no_platform"].is_multi_platform is False
    assert rows["no_platform"].platform_clean is None


def test_relabel_keeps_unknown_names(spark):
    df = spark.createDataFrame([("roas",), ("other",), (None,)], "m string")
    assert [r[0] for r in df.select(relabel("m", {"roas": "ROAS"})).collect()] == ["ROAS", "other", None]


def test_priority_edges(spark):
    df = spark.createDataFrame([(0.70,), (0.6999,), (0.48,), (0.4799,), (None,), (math.nan,)], "s double")
    got = [r[0] for r in df.select(priority("s", 0.70, 0.48)).collect()]
    assert got == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "LOW"]


def test_effect_labels(spark):
    df = spark.createDataFrame([(0.1,), (-0.2,), (0.5,), (-0.8,), (None,)], "d double")
    got = [r[0] for r in df.select(effect_label("d")).collect()]
    assert got == ["negligible", "small", "medium", "large", "-"]
    assert df.select(effect_text("d")).first()[0] == "d=0.10 negl."


def test_strength_of_tiny_p(spark):
    df = spark.createDataFrame([(0.0,), (0.01,)], "p double")
    assert [r[0] for r in df.select(strength("p")).collect()] == [10.0, 2.0]


def test_ratio_or_zero(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (0, 5)], "a int, b int")
    got = [r[0] for r in df.select(ratio_or_zero("a", "b", 100, 3)).collect()]
    assert got == [33.333, 0.0, 0.0]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, 3.0, 6.0), (1.0, None, 9.0)],
                               "c double, x double, y double")
    r = df.agg(pearson("c", "x").alias("a"), pearson("x", "y").alias("b")).first()
    assert r.a is None and r.b == pytest.approx(1.0)
    assert df.where(F.lit(False)).agg(pearson("x", "y")).first()[0] is None
