"""Tests, resampling and reports against known values and brute force."""

import itertools
import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from adquanta.experiments import report
from adquanta.experiments.bootstrap import (
    PRIME,
    _drawer,
    _steps,
    arm_intervals,
    difference_intervals,
    poisson_limits,
    replicate_means,
    replicate_medians,
    replicate_statistic,
    replicated,
    weighted_sums,
)
from adquanta.experiments.moments import arm_moments, with_effects
from adquanta.experiments.pvalues import (
    exact_u_two_sided,
    mann_whitney_p,
    student_two_sided,
    welch_p,
)
from adquanta.experiments.ranks import rank_statistics, roc_area
from adquanta.experiments.spec import ExperimentSpec, campaign_experiments, members, samples
from adquanta.operators.quantiles import with_value_ranges
from adquanta.sources.files import write_report


def arms(spark, a, b, test="t"):
    rows = [(test, "a", float(v)) for v in a] + [(test, "b", float(v)) for v in b]
    return spark.createDataFrame(rows, "test string, arm string, value double").repartition(3)


def effects(spark, a, b, **kw):
    return with_effects(arm_moments(arms(spark, a, b), ["test"]), **kw).first()


def test_student_tail_known_values():
    t = np.array([2.228139, 12.7062, 1.959964, 0.0, 40.0, np.inf, np.nan, 4.0])
    df = np.array([10, 1, 1e9, 5, 300, 1, 3, 2])
    p = student_two_sided(t, df)
    assert p[:3] == pytest.approx([0.05, 0.05, 0.05], abs=2e-6)
    assert p[3] == 1.0 and p[4] < 1e-100 and p[5] == 0.0 and math.isnan(p[6])
    # Two degrees of freedom have a closed form.
    assert p[7] == pytest.approx(1 - 4 / math.sqrt(2 + 16), rel=1e-12)


@pytest.mark.parametrize("n_a,n_b", [(1, 5), (3, 4), (4, 4), (2, 7)])
def test_exact_u_against_enumeration(n_a, n_b):
    n = n_a + n_b
    us = [sum(c) - n_a * (n_a - 1) // 2 for c in itertools.combinations(range(n), n_a)]
    for u in range(n_a * n_b + 1):
        tail = min(u, n_a * n_b - u)
        want = min(1.0, 2 * sum(x <= tail for x in us) / len(us))
        assert exact_u_two_sided(u, n_a, n_b) == pytest.approx(want, rel=1e-9)


def test_effects_of_a_small_sample(spark):
    r = effects(spark, [1, 2, 3, 4], [3, 5, 7])
    assert (r.n_a, r.n_b, r.mean_a, r.mean_b) == (4, 3, 2.5, 5.0)
    assert r.lift_pct == pytest.approx(100.0)
    pooled = math.sqrt((3 * (5 / 3) + 2 * 4) / 5)
    assert r.cohens_d == pytest.approx(-2.5 / pooled)
    assert r.effect_size == "large"
    va, vb = (5 / 3) / 4, 4 / 3
    assert r.t_statistic == pytest.approx(-2.5 / math.sqrt(va + vb))
    assert r.welch_df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 2))


def test_swapped_arms_negate(spark):
    x, y = effects(spark, [1, 2, 4], [2, 6, 9, 9]), effects(spark, [2, 6, 9, 9], [1, 2, 4])
    assert x.cohens_d == pytest.approx(-y.cohens_d)
    assert x.t_statistic == pytest.approx(-y.t_statistic)
    assert x.welch_df == pytest.approx(y.welch_df)


def test_constant_and_short_samples(spark):
    same = effects(spark, [2, 2], [2, 2])
    assert same.cohens_d == 0.0 and same.t_statistic is None
    apart = effects(spark, [2, 2], [3, 3])
    assert apart.cohens_d == 0.0 and apart.t_statistic == -math.inf
    assert effects(spark, [2, 2], [3, 3], zero_sd="epsilon").cohens_d == pytest.approx(-1e9)
    short = effects(spark, [2], [3, 4])
    assert short.cohens_d is None and short.t_statistic is None and short.effect_size == "-"
    assert effects(spark, [-1, 1], [3, 4]).lift_pct == 0.0


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def rank_rows(spark, tests, ranges):
    frames = [arms(spark, a, b, name) for name, (a, b) in tests.items()]
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    if ranges:
        long = with_value_ranges(long, ["value"], ranges=ranges)
    return {r.test: r for r in rank_statistics(long, ["test"]).collect()}


@pytest.mark.parametrize("ranges", [None, 6])
def test_ranks_against_all_pairs(spark, ranges):
    rng = random.Random(3)
    tests = {
        "ties": ([rng.randint(0, 6) for _ in range(60)], [rng.randint(1, 7) for _ in range(45)]),
        "hot value": ([5] * 80 + [1, 9], [5] * 10 + [2, 3, 8]),
        "uneven": ([rng.random() for _ in range(3)], [rng.random() for _ in range(200)]),
        "equal": ([4, 4], [4, 4, 4]),
    }
    got = rank_rows(spark, tests, ranges)
    for name, (a, b) in tests.items():
        r, u, na, nb = got[name], brute_u(a, b), len(a), len(b)
        assert r.u_statistic == pytest.approx(u)
        assert (r.median_a, r.median_b) == pytest.approx((np.median(a), np.median(b)))
        both = [*a, *b]
        ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        assert r.tie_term == ties
        n = na + nb
        sd = math.sqrt(max(na * nb / 12 * (n + 1 - ties / (n * (n - 1))), 0))
        if sd:
            assert r.u_z == pytest.approx((max(u, na * nb - u) - na * nb / 2 - 0.5) / sd)
        else:
            assert r.u_z is None


def test_both_u_add_up(spark):
    a, b = [1, 4, 4, 9], [2, 4, 7]
    got = rank_rows(spark, {"x": (a, b), "y": (b, a)}, 4)
    assert got["x"].u_statistic + got["y"].u_statistic == len(a) * len(b)


def test_p_values_as_columns(spark):
    rows = [(6.0, 1.9, 3, 4, 0.0), (50.0, 1.959964, 20, 20, 0.0), (5.0, None, 4, 4, 60.0),
            (None, None, 0, 4, None)]
    df = spark.createDataFrame(rows, "u double, z double, na long, nb long, ties double")
    p = [r[0] for r in df.select(mann_whitney_p("u", "z", "na", "nb", "ties")).collect()]
    assert p[0] == 1.0  # exact: the middle of the distribution
    assert p[1] == pytest.approx(0.05, abs=1e-6)
    assert p[2] == 1.0 and p[3] is None
    t = spark.createDataFrame([(2.228139, 10.0), (None, 3.0)], "t double, df double")
    got = [r[0] for r in t.select(welch_p("t", "df")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None


def test_roc_area(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9) + (i % 2) * 2.0, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = brute_u(pos, neg) / (len(pos) * len(neg))
    assert roc_area(df, "s", "y").first().auc == pytest.approx(want)


# Resampling --------------------------------------------------------------

@pytest.fixture(scope="module")
def campaigns(spark):
    """400 rows; some without a platform or a metric."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        platform = None if i % 40 == 0 else ("F,I" if i % 3 == 0 else "F")
        roas = None if i % 50 == 1 else rng.gauss(6 if platform == "F,I" else 5, 2)
        rows.append((i, platform, "25-34" if i % 2 else "45-54", roas, float(rng.randint(0, 9))))
    return spark.createDataFrame(
        rows, "ad_id long, platform string, target_age string, roas double, conversions double")


SPECS = [
    ExperimentSpec("multi", "single", "multi", "not contains(platform, ',')",
                   "contains(platform, ',')", ("roas", "conversions")),
    ExperimentSpec("age", "young", "old", "target_age = '25-34'", "target_age = '45-54'", ("roas",)),
]


def test_weights_are_poisson_and_independent_of_partitions(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("row_id"))
    first = replicated(ids, 20)
    again = replicated(ids.repartition(7), 20)
    total = lambda d: sorted(map(tuple, d.groupBy("replicate").agg(F.sum("weight")).collect()))
    assert total(first) == total(again)
    counts = {r.weight: r.n for r in first.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    n = 3000 * 20
    assert counts[1] / n == pytest.approx(math.exp(-1), abs=0.01)
    assert counts[2] / n == pytest.approx(math.exp(-1) / 2, abs=0.01)
    assert sum(w * c for w, c in counts.items()) / n == pytest.approx(1, abs=0.02)
    other = replicated(ids, 20, seed=20)
    assert total(first) != total(other)


def test_matrix_sums_equal_exploded_sums(spark, campaigns):
    rows = members(campaigns, SPECS).fillna(0)
    matrix = weighted_sums(rows, ["experiment", "arm"], ["roas", "conversions"], 30)
    exploded = replicated(rows, 30).groupBy("experiment", "arm", "replicate").agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("roas", "conversions")])
    key = lambda r: (r.experiment, r.arm, r.replicate)
    a = {key(r): (r.roas, r.conversions) for r in matrix.collect()}
    b = {key(r): (r.roas, r.conversions) for r in exploded.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_intervals_match_theory(spark, campaigns):
    rows = members(campaigns, SPECS)
    stats = replicate_means(rows, SPECS, 1000)
    got = {(r.experiment, r.metric, r.arm): r.ci for r in arm_intervals(stats).collect()}
    assert len(got) == 6
    for r in samples(rows, SPECS).groupBy("experiment", "metric", "arm").agg(
            F.avg("value").alias("m"), F.stddev_samp("value").alias("s"),
            F.count("*").alias("n")).collect():
        low, high = got[(r.experiment, r.metric, r.arm)]
        half = 1.96 * r.s / math.sqrt(r.n)
        assert low < r.m < high
        assert (low, high) == pytest.approx((r.m - half, r.m + half), abs=0.25 * half)
    diff = {(r.experiment, r.metric): r for r in difference_intervals(stats).collect()}
    assert diff[("multi", "roas")].ci_excludes_zero
    assert diff[("multi", "roas")].ci_lower > 0


def test_cells_use_all_rows(spark, campaigns):
    rows = members(campaigns, SPECS)
    whole = {(r.experiment, r.metric, r.arm): r.ci
             for r in arm_intervals(replicate_means(rows, SPECS, 500)).collect()}
    cells = {(r.experiment, r.metric, r.arm): r.ci
             for r in arm_intervals(replicate_means(rows, SPECS, 500, cells=64)).collect()}
    for k, (low, high) in whole.items():
        assert cells[k] == pytest.approx([low, high], abs=0.5 * (high - low))


@pytest.mark.parametrize("width", [0.2, 7.0])
def test_medians_per_replicate(spark, campaigns, width):
    """Intervals that are too narrow at first are widened until no median is missed."""
    long = samples(members(campaigns, SPECS), SPECS)
    got = {(r.experiment, r.metric, r.arm, r.replicate): r.stat
           for r in replicate_medians(long, 25, width=width).collect()}
    copies = {}
    for r in replicated(long, 25).collect():
        copies.setdefault((r.experiment, r.metric, r.arm, r.replicate), []).extend([r.value] * r.weight)
    assert got.keys() == copies.keys()
    assert all(got[k] == pytest.approx(np.median(v)) for k, v in copies.items())


def test_medians_of_tied_rows_send_sums(spark, monkeypatch):
    """Of five distinct values only the sums of their weights meet, however many rows share one."""
    from adquanta.experiments import bootstrap

    rng = random.Random(4)
    # A third of the rows share one value; a second metric has no ties.
    values = {"tied": [rng.choice([1.0, 2.0, 3.0, 3.0, 4.0, 5.0]) for _ in range(6000)],
              "free": [rng.random() for _ in range(600)],
              "both": [rng.choice([-0.0, 0.0, rng.gauss(0, 1)]) for _ in range(3000)]}
    long = spark.createDataFrame(
        [("e", m, "ab"[i % 2], f"{m}{i}", v) for m, vs in values.items() for i, v in enumerate(vs)],
        "experiment string, metric string, arm string, row_id string, value double").repartition(5)
    drawn = spark.sparkContext.accumulator(0)
    real = bootstrap._drawer

    def counting(replicates, seed):
        draw = real(replicates, seed)

        def counted(x, y):
            drawn.add(len(x))
            return draw(x, y)
        return counted

    want = {}
    for r in replicated(long, 30).collect():
        want.setdefault((r.metric, r.arm, r.replicate), []).extend([r.value] * r.weight)
    monkeypatch.setattr(bootstrap, "_drawer", counting)
    got = {(r.metric, r.arm, r.replicate): r.stat for r in replicate_medians(long, 30).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(np.median(v)) for k, v in want.items())
    # All rows are drawn once for the sums; of 6000 tied and 2000 rows at zero none is drawn again.
    assert drawn.value - 9600 < 2500


def test_statistic_as_a_callable(spark, campaigns):
    rows = members(campaigns, SPECS)

    def mean(value, weight):
        return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)

    key = lambda r: (r.experiment, r.metric, r.arm, r.replicate)
    mine = {key(r): r.stat for r in replicate_statistic(samples(rows, SPECS), mean, 20).collect()}
    want = {key(r): r.stat for r in replicate_means(rows, SPECS, 20).collect()}
    assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in mine)


# Records and reports -----------------------------------------------------

def test_missing_platform_joins_neither_arm(spark, campaigns):
    n = members(campaigns, SPECS[:1]).count()
    assert n == campaigns.where("platform is not null").count()


def test_run_experiments_record(spark, campaigns):
    out = report.run_experiments(campaigns, SPECS, replicates=100)
    assert out.count() == 3
    fields = {"metric", "group_a", "group_b", "n_a", "n_b", "mean_a", "mean_b", "median_a",
              "median_b", "std_a", "std_b", "lift_pct", "t_statistic", "p_value_ttest",
              "u_statistic", "p_value_mwu", "cohens_d", "effect_size", "ci_lower", "ci_upper",
              "ci_excludes_zero", "ci_a", "ci_b", "significant_ttest", "significant_mwu",
              "significant_both"}
    assert fields <= set(out.columns)
    best = {(r.experiment, r.metric): r for r in report.with_verdict(out).collect()}[("multi", "roas")]
    assert best.significant_both and best.winner == "multi" and best.direction == "up"


def test_lower_is_better_turns_the_verdict(spark):
    df = spark.createDataFrame([("cac", "x", "y", 5.0, 3.0)],
                               "metric string, group_a string, group_b string, mean_a double, mean_b double")
    assert report.with_verdict(df).first().winner == "x"
    r = report.with_verdict(df, ["cac"]).first()
    assert (r.winner, r.loser, r.direction) == ("y", "x", "down")


def test_bonferroni_within_experiments(spark):
    rows = [("e", "m1", 0.01), ("e", "m2", 0.03), ("f", "m1", 0.03), ("f", "m2", None)]
    df = spark.createDataFrame(rows, "experiment string, metric string, p_value_ttest double")
    got = {(r.experiment, r.metric): r for r in report.with_bonferroni(df).collect()}
    assert got[("e", "m1")].bonferroni_alpha == 0.025
    assert [got[k].significant_bonferroni for k in sorted(got)] == [True, False, False, False]
    assert got[("e", "m2")].n_significant_bonferroni == 1


def test_report_document(spark, campaigns, tmp_path):
    path = str(tmp_path / "report")
    write_report(report.nested_report(report.run_experiments(campaigns, SPECS, replicates=50)), path)
    files = list((tmp_path / "report").glob("*.json"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert len(files) == 1
    doc = json.loads(lines[0])
    assert len(lines) == 1 and doc["total_hypotheses"] == 3
    assert doc["bonferroni_alpha"] == pytest.approx(round(0.05 / 3, 4))
    names = [(e["name"], e["metric"]) for e in doc["experiments"]]
    assert names == [("single vs multi", "roas"), ("single vs multi", "conversions"),
                     ("young vs old", "roas")]
    assert all(len(e["ci_95"]) == 2 for e in doc["experiments"])


def test_standard_experiments_are_fourteen():
    specs = campaign_experiments(advertiser_a="O'Neil")
    assert sum(len(s.metrics) for s in specs) == 14
    assert specs[3].where_a == "advertiser = 'O\\'Neil'"


def test_advertiser_tests_skip_and_flag(spark):
    rows = []
    for i in range(30):
        rows.append(("big", "A,B" if i % 2 else "A", float(i), 1.0 * (i % 5), i))
    rows += [("few", "A", 1.0, 1.0, 1), ("few", "A", 2.0, 1.0, 2), ("few", "A,B", 5.0, 2.0, 3),
             ("few", None, 3.0, 1.0, 2), ("few", "A,B", 6.0, 3.0, 1)]
    rows += [("lone", "A", 1.0, 1.0, 1), ("lone", "A,B", 1.0, 1.0, 1)]
    df = spark.createDataFrame(
        rows, "advertiser string, platform string, roas double, ctr_pct double, conversions int")
    table = report.advertiser_table(report.advertiser_tests(df)).collect()
    got = {(r.advertiser, r.metric): r for r in table}
    assert {a for a, _ in got} == {"big", "few"}
    few = got[("few", "roas")]
    assert (few.n_a, few.n_b, few.small_sample) == (3, 2, True)  # a missing platform is a single one
    assert not got[("big", "roas")].small_sample
    assert got[("big", "conversions")].mean_a == 14.0
    assert few.d_label.startswith("d=") and few.signif_log >= 0


@pytest.mark.parametrize("n_a", range(1, 9))
def test_exact_u_has_no_largest_size(n_a):
    """The closed form at 20 million rows: U = 0 has one arrangement, and halves meet in the middle."""
    n_b = 20_000_000
    assert exact_u_two_sided(0, n_a, n_b) == pytest.approx(2 / math.comb(n_a + n_b, n_a), rel=1e-12)
    assert exact_u_two_sided(n_a * n_b / 2, n_a, n_b) == pytest.approx(1.0, abs=1e-6)
    z = (n_a * n_b * 0.2 - 0.5) / math.sqrt(n_a * n_b * (n_a + n_b + 1) / 12)
    if n_a == 8:
        assert exact_u_two_sided(n_a * n_b * 0.3, n_a, n_b) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.01)


def test_two_sample_test_from_sql(spark):
    """The table function against the operators, with arms that are short, constant or missing."""
    from adquanta.experiments.moments import arm_moments, with_effects
    from adquanta.experiments.pvalues import welch_p
    from adquanta.experiments.table_function import arm_rows, register_two_sample_test

    register_two_sample_test(spark)
    rng = random.Random(12)
    rows = [(e, "m", arm, rng.gauss(5 if arm == "a" else 5.5, 2)) for e in ("x", "y", None) for arm in "ab" for _ in range(60)]
    rows += [("flat", "m", "a", 1.0)] * 3 + [("flat", "m", "b", 1.0)] * 4 + [("apart", "m", "a", 2.0)] * 3
    rows += [("apart", "m", "b", 1.0)] * 3 + [("one", "m", "a", 1.0)] + [("one", "m", "b", 2.0)] * 5
    rows += [("alone", "m", "b", 2.0)] * 5 + [("x", "m", "a", None)]
    long = spark.createDataFrame(rows, "experiment string, metric string, arm string, value double")
    arms = arm_rows(long, ["experiment", "metric"])
    got = {r.experiment: r for r in spark.sql("SELECT * FROM two_sample_test(TABLE({arms}))", arms=arms).collect()}
    want = with_effects(arm_moments(long, ["experiment", "metric"])).withColumn("p", welch_p("t_statistic", "welch_df"))
    assert len(got) == 7
    for w in want.collect():
        g = got[w.experiment]
        assert (g.n_a, g.n_b, g.metric) == (w.n_a, w.n_b, "m")
        if w.experiment in ("x", "y", None):
            assert g.t_statistic == pytest.approx(w.t_statistic) and g.welch_df == pytest.approx(w.welch_df)
            assert g.cohens_d == pytest.approx(w.cohens_d) and g.p_value == pytest.approx(w.p)
            assert g.significant == (w.p < 0.05)
    assert got["apart"].p_value == 0.0 and got["apart"].significant
    assert got["one"].p_value is None and got["alone"].mean_a is None and not got["alone"].significant
    assert got["flat"].cohens_d == 0.0 and not got["flat"].significant


def test_two_sample_test_names_what_it_lacks(spark):
    from pyspark.errors import AnalysisException

    from adquanta.experiments.table_function import register_two_sample_test

    register_two_sample_test(spark)
    for text in ("SELECT * FROM two_sample_test(TABLE(SELECT 1 AS n))",
                 "SELECT * FROM two_sample_test(TABLE(SELECT 'a' AS arm, 1 AS n, 1.0D AS mean, 1.0D AS std), 2)"):
        with pytest.raises(AnalysisException):
            spark.sql(text).collect()


def test_weights_are_drawn_in_blocks_and_follow_the_formula():
    ids = np.random.default_rng(5).integers(1, 2**28 + 1, (2, 1500))
    draw = _drawer(1000, 3)
    draw(*ids[:, :2])
    tracemalloc.start()
    weights = draw(*ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * weights.nbytes
    p, q = (np.array(s, dtype=object) for s in _steps(1000, 3))
    u = (np.multiply.outer(ids[0, :40].astype(object), p) + np.multiply.outer(ids[1, :40].astype(object), q)) % PRIME
    wanted = np.searchsorted(poisson_limits(), u.astype(np.int64), "right")
    assert (weights[:40] == wanted).all() and wanted.max() >= 5


def test_sums_of_rows_that_share_ids_and_keys(spark):
    rows = [("e", a, str(i % 7), float(i)) for i in range(40) for a in (("a",), ("b",), ("a", "b"))[i % 3]]
    df = spark.createDataFrame(rows + rows[:9] + [(None, "a", "3", 2.0)], "experiment string, arm string, row_id string, v double")
    got = {tuple(r)[:3]: r.v for r in weighted_sums(df, ["experiment", "arm"], ["v"], 50).collect()}
    plain = replicated(df, 50).groupBy("experiment", "arm", "replicate").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
    wanted = {tuple(r)[:3]: r.v for r in plain.collect()}
    assert len(got) == 150 and {k: v for k, v in got.items() if v} == pytest.approx({k: v for k, v in wanted.items() if v})
