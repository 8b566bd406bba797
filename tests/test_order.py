"""Quantiles, positions, joins: the paths for large tables against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adquanta.operators import distributions, joins, quantiles, scoring, segments
from adquanta.operators.distributions import box_summary, histogram
from adquanta.operators.positions import with_position
from adquanta.operators.quantiles import (
    approximate_quantile,
    exact_quantiles,
    grouped_quantiles,
)
from adquanta.operators.segments import above_sigma, selection
from adquanta.operators.topk import top_above_quantile


@pytest.fixture(scope="module")
def values(spark):
    """5,000 values of which a third are equal, with nulls and NaN."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", 7.5 if i % 3 == 0 else rng.gauss(10, 4))
            for i in range(5000)]
    rows += [(5000, "hot", None), (5001, "hot", float("nan"))]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(6)


def clean(values):
    return [(r.g, r.v) for r in values.collect() if r.v is not None and r.v == r.v]


@pytest.mark.parametrize("held", [20, 500_000])
def test_exact_quantiles(values, held, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD_ROWS", held)
    points = [0.0, 0.33, 0.5, 0.66, 0.95, 1.0]
    want = np.quantile([v for _, v in clean(values)], points)
    assert exact_quantiles(values, "v", points) == pytest.approx(list(want), rel=1e-12)


def test_quantiles_of_nothing(values):
    assert exact_quantiles(values.where("v is null"), "v", [0.5]) == [None]


@pytest.mark.parametrize("ranges", [5, 64, None])
def test_grouped_quantiles(values, ranges):
    got = {r.g: r for r in grouped_quantiles(
        values, ["g"], "v", {"a": 0.25, "b": 0.5}, ranges).collect()}
    data = clean(values)
    assert set(got) == {g for g, _ in data}
    for g in got:
        mine = [v for k, v in data if k == g]
        assert got[g].n == len(mine)
        assert (got[g].a, got[g].b) == pytest.approx(tuple(np.quantile(mine, [0.25, 0.5])), rel=1e-12)


def test_grouped_quantiles_keep_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "g string, v double")
    got = {r.g: r.m for r in grouped_quantiles(df, ["g"], "v", {"m": 0.5}, 4).collect()}
    assert got == {None: 2.0, "x": 5.0}


def test_approximate_quantile_rank_error(values):
    data = sorted(v for _, v in clean(values))
    got = values.where(~F.isnan("v")).agg(approximate_quantile("v", 0.75, 0.05)).first()[0]
    below = sum(v < got for v in data)
    upto = sum(v <= got for v in data)
    assert below - 0.05 * len(data) <= 0.75 * len(data) <= upto + 0.05 * len(data)


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_per_key(values, partitions):
    rows = with_position(values, ["v", "id"], ["g"], partitions=partitions).collect()
    assert len(rows) == values.count()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.g, []).append(r)
    for group in by_key.values():
        ordered = sorted(group, key=lambda r: r.position)
        assert [r.position for r in ordered] == list(range(1, len(group) + 1))

        # Nulls first, NaN last, as Spark sorts.
        assert [r.id for r in ordered] == [r.id for r in sorted(
            group, key=lambda r: (r.v is not None, bool(r.v is not None and r.v != r.v),
                                  0 if r.v is None or r.v != r.v else r.v, r.id))]


def test_global_positions(values):
    rows = with_position(values, ["id"], partitions=5).collect()
    assert sorted((r.id, r.position) for r in rows) == [(i, i + 1) for i in range(len(rows))]


def test_null_key_has_its_own_positions(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, o int")
    got = {(r.k, r.o): r.position for r in with_position(df, ["o"], ["k"]).collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_shuffled_join_equals_broadcast(spark, values, how):
    values = values.union(spark.createDataFrame([(9, None, 1.0), (10, None, 2.0)], values.schema))
    dim = values.where("g is null or g != 'g1'").groupBy("g").agg(F.count("*").alias("n"))
    key = lambda r: (r.id, r.g, r.n)
    small = sorted(map(key, joins.join_dimension(values, dim, ["g"], how).collect()), key=str)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = sorted(map(key, joins.join_dimension(values, dim, ["g"], how).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert small == large
    assert {(9, None, 2), (10, None, 2)} <= set(small)


def test_quantiles_take_few_passes(spark, values):
    tracker = spark.sparkContext.statusTracker()

    def jobs(points):
        spark.sparkContext.setJobGroup(f"quantiles{len(points)}", "passes")
        exact_quantiles(values, "v", points)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"quantiles{len(points)}"))

    # Adaptive execution may run a pass as several jobs; more quantiles add none.
    assert jobs([0.1, 0.2, 0.33, 0.45, 0.66, 0.8, 0.9]) <= jobs([0.5]) + 1 <= 11


def test_nan_is_missing_in_scores_and_limits(spark):
    rows = [(i, float(i), 1.0 + i % 3, 2.0 + i % 5) for i in range(20)] + [(20, float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, roas double, ctr_pct double, cr_pct double")
    scored = {r.id: r for r in scoring.tercile_priority(scoring.composite_score(df)).collect()}
    assert {r.priority for i, r in scored.items() if i < 20} == {"LOW", "MEDIUM", "HIGH"}
    assert scored[20].ml_score is None and scored[20].priority == "LOW"
    high = spark.createDataFrame([(i, 1.0) for i in range(30)] + [(30, 100.0), (31, float("nan"))], "id int, v double")
    assert [r.id for r in segments.above_sigma(high, ["v"]).collect()] == [30]


def test_box_summary_keeps_a_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("x", 5.0)], "g string, v double")
    got = {r.g: r.median for r in distributions.box_summary(df, ["g"], "v").collect()}
    assert got == {None: 4.0, "x": 5.0}


def test_group_mean_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "k string, v double")
    rows = joins.with_group_mean(df, "k", "v", "m", "d").collect()
    assert sorted((r.k, r.m, r.d) for r in rows) == [("a", 2.0, -1.0), ("a", 2.0, 1.0)]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double")
    assert {r.bin: r.n for r in histogram(df, "v", [], 40).collect()} == {1: 1, 21: 1, 40: 1}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bin, r.n) for r in histogram(df, "v", [], 10).collect()] == [(1, 2)]


def test_box_summary(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    r = box_summary(df, ["g"], "v").first()
    assert (r.n, r.q1, r.median, r.q3) == (6, 2.25, 3.5, 4.75)
    assert (r.whisker_low, r.whisker_high) == (1.0, 5.0)


def test_one_sided_outliers_in_any_column(spark):
    rows = [(i, 1.0, 1.0) for i in range(50)] + [(50, 90.0, 1.0), (51, 1.0, 90.0), (52, -90.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    assert {r.id for r in above_sigma(df, ["a", "b"]).collect()} == {50, 51}


def test_selection(spark):
    df = spark.createDataFrame([("x", "A,B"), ("x", "C"), ("y", "A"), ("z", None)],
                               "advertiser string, platform string")
    pick = lambda a, p: sorted(map(tuple, selection(df, a, p).collect()))
    assert pick(["x"], ["A"]) == [("x", "A,B")]
    assert pick(None, ["A", "C"]) == [("x", "A,B"), ("x", "C"), ("y", "A")]
    assert pick(["x", "y"], []) == [] and pick([], None) == []
    many = ["x", *map(str, range(2000))]
    assert pick(many, ["A"]) == [("x", "A,B")]


def test_top_above_quantile_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(40)], "id int, q double, v double")
    assert [r.id for r in top_above_quantile(df, "q", 0.5, "v", "id").collect()] == [20, 21, 22, 23]
