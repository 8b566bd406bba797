"""Bags of little bootstraps against plain weights, plain resampling and odd input."""

import hashlib
import math
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from adquanta.experiments.bags import (
    bag_intervals,
    bag_statistics,
    poisson_weights,
    ratio_of_sums,
    trimmed_mean,
)
from adquanta.experiments.bootstrap import MULTIPLIERS, PRIME
from adquanta.experiments.spec import ExperimentSpec, ratio_samples


@pytest.mark.parametrize("mean", [0.5, 1.0, 7.25, 400.0, 200_000.0])
def test_weights_have_the_mean_and_variance_of_the_law(mean):
    low, limits = poisson_weights(mean)
    u = np.random.default_rng(1).integers(0, PRIME, 100_000)
    weight = low + np.searchsorted(limits, u, "right")
    assert weight.mean() == pytest.approx(mean, abs=5 * math.sqrt(mean / len(u)))
    assert weight.var() == pytest.approx(mean, rel=0.05)
    assert len(limits) < 30 * math.sqrt(mean) + 60


def plain(rows, bag_rows, replicates, statistic):
    """The same in plain Python, row by row: rows are (key, id, columns)."""
    size, found = {}, {}
    for key, _, _ in rows:
        size[key] = size.get(key, 0) + 1
    held = {}
    for key, i, columns in rows:
        digest = hashlib.md5(i.encode()).hexdigest()
        x, y, z = (int(digest[k:k + 7], 16) for k in (0, 7, 14))
        held.setdefault((key, z % math.ceil(size[key] / bag_rows)), []).append((x + 1, y + 1, columns))
    for (key, bag), members in held.items():
        low, limits = poisson_weights(size[key] / len(members))
        for r in range(replicates):
            p, q = (pow(m, r + 1, PRIME) for m in MULTIPLIERS)
            drawn = [(low + bisect_right(limits.tolist(), (x * p + y * q) % PRIME), c) for x, y, c in members]
            found[key, bag, r] = statistic(drawn)
    return found


def plain_trimmed(drawn):
    values = sorted(c[0] for w, c in drawn for _ in range(w))
    cut = len(values) * 0.1
    ends = [(i, i + 1) for i in range(len(values))]
    kept = [max(0, min(b, len(values) - cut) - max(a, cut)) for a, b in ends]
    return sum(v * k for v, k in zip(values, kept)) / sum(kept) if values else None


def plain_ratio(drawn):
    bottom = sum(w * c[1] for w, c in drawn)
    return sum(w * c[0] for w, c in drawn) / bottom if bottom else None


def frame(spark, rows, parts):
    return spark.createDataFrame([(k, i, *c) for k, i, c in rows],
                                 "arm string, row_id string, top double, bottom double").repartition(parts)


@pytest.mark.parametrize("statistic,by_hand", [(trimmed_mean(), plain_trimmed), (ratio_of_sums, plain_ratio)])
def test_statistics_equal_plain_resampling(spark, statistic, by_hand):
    rng = random.Random(5)
    # A hot arm with tied values, a small one, a null one, and one of a single row without a denominator.
    rows = [("hot", f"h{i}", (float(rng.choice([1, 2, 2, 2, 3])), rng.random())) for i in range(700)]
    rows += [("small", f"s{i}", (rng.gauss(0, 1), 1.0)) for i in range(7)]
    rows += [(None, f"n{i}", (rng.random(), 2.0)) for i in range(40)] + [("one", "x", (1.0, 0.0))]
    want = plain(rows, 100, 12, by_hand)
    for parts in (1, 5):
        got = {(r.arm, r.bag, i): v
               for r in bag_statistics(frame(spark, rows, parts), ["arm"], ["top", "bottom"], statistic, 12, 100).collect()
               for i, v in enumerate(r.stats)}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v))


def test_intervals_cover_and_have_the_width_of_theory(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(10.0, 2.0, 20_000)
    rows = frame(spark, [("a", str(i), (float(v), 1.0)) for i, v in enumerate(values)], 4)
    stats = bag_statistics(rows, ["arm"], ["top", "bottom"], ratio_of_sums, 200, 1000)
    got = bag_intervals(stats, ["arm"]).first()
    assert got.bags == 20 and got.lower < values.mean() < got.upper
    assert got.upper - got.lower == pytest.approx(2 * 1.96 * 2.0 / math.sqrt(20_000), rel=0.15)


def test_bags_stay_small_whatever_the_arm(spark):
    """No task gets more than a bag, and no row is multiplied by the replicates."""
    rows = frame(spark, [("a", str(i), (1.0, 1.0)) for i in range(6000)], 4)
    largest = spark.sparkContext.accumulator(0)

    def sized(columns, weights):
        largest.add(len(columns) if len(columns) > 700 else 0)
        return weights.sum(axis=0)

    stats = bag_statistics(rows, ["arm"], ["top"], sized, 20, 500)
    sums = stats.select(F.explode("stats").alias("n")).agg(F.avg("n"), F.count("*")).first()
    assert largest.value == 0 and sums[1] == 12 * 20
    assert sums[0] == pytest.approx(6000, rel=0.01)  # each bag stands for all rows
    assert "Generate" not in stats._jdf.queryExecution().executedPlan().toString()


def test_missing_and_no_rows(spark):
    rows = frame(spark, [("a", "1", (None, 1.0)), ("a", "2", (3.0, None)), ("a", "3", (4.0, 2.0))], 1)
    stats = bag_statistics(rows, ["arm"], ["top", "bottom"], ratio_of_sums, 30)
    assert {v for v in stats.first().stats if v is not None} == {2.0}
    assert bag_intervals(bag_statistics(rows.limit(0), ["arm"], ["top"], trimmed_mean(), 5), ["arm"]).count() == 0


def test_ratio_samples_lay_out_the_sums_of_each_metric(spark):
    df = spark.createDataFrame(
        [(1, "x", 5, 100, 2, 30.0, 10.0), (2, "y", None, 50, 1, 8.0, 4.0), (3, "z", 1, 1, 1, 1.0, 1.0)],
        "ad_id int, g string, clicks int, impressions int, conversions int, revenue double, spent double")
    specs = [ExperimentSpec("e", "x", "y", "g = 'x'", "g = 'y'", ("ctr_pct", "roas", "conversions"))]
    got = {(r.metric, r.arm): (r.top, r.bottom) for r in ratio_samples(df, specs).collect()}
    assert got == {("ctr_pct", "a"): (500.0, 100.0), ("roas", "a"): (30.0, 10.0), ("conversions", "a"): (2.0, 1.0),
                   ("roas", "b"): (8.0, 4.0), ("conversions", "b"): (1.0, 1.0)}
