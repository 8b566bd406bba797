"""Sketches against exact counts, and the pivot over common values."""

import random

from pyspark.sql import functions as F

from adquanta.operators import kpis, sketches
from adquanta.session import stage


def test_merged_quantile_sketches_keep_the_rank_bound(spark):
    rng = random.Random(1)
    rows = [(i % 7, "hot" if i % 3 else f"k{i % 4}", rng.choice([1.0, rng.gauss(0, 100), None, float("nan")]))
            for i in range(20_000)]
    df = spark.createDataFrame(rows + [(0, None, 5.0), (0, "empty", None)], "day long, key string, v double")
    points = {"q1": 0.25, "q2": 0.5, "q9": 0.99}
    daily = stage(sketches.quantile_sketches(df, ["key", "day"], "v"), "daily")
    merged = stage(sketches.sketch_quantiles(sketches.merged_quantile_sketches(daily, ["key"]), points), "merged")
    n = {r.key: (r.n, r.q2) for r in merged.collect()}
    for key in ("hot", "k0", "k3"):
        assert n[key][0] == sum(1 for _, k, v in rows if k == key and v is not None and v == v)
    assert n[None] == (1, 5.0) and n["empty"] == (0, None)
    got = sketches.rank_errors(df, merged.select("key", *points), ["key"], "v", points).collect()
    assert len(got) == 6 and all(r.error <= 0.03 for r in got)


def test_rank_error_is_the_distance_to_the_tied_ranks(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 2, 3, 4, 5, 6, 7, 8]], "k string, v double")
    for q, error in ((2.0, 0.0), (3.0, 0.1), (0.0, 0.3), (9.0, 0.7)):
        quantiles = stage(spark.createDataFrame([("a", q)], "k string, p double"), "q")
        assert abs(sketches.rank_errors(df, quantiles, ["k"], "v", {"p": 0.3}).first().error - error) < 1e-9


def test_distinct_and_overlap(spark):
    rows = [(d, "x", i) for d in range(3) for i in range(d * 1000, d * 1000 + 2000)] + [(0, "y", i) for i in range(3500, 9000)]
    df = spark.createDataFrame([*rows, *rows[:500], (1, "y", None)], "day long, key string, user long")
    daily = sketches.distinct_sketches(df, ["key", "day"], "user")
    got = {r.key: r.n_distinct for r in sketches.merged_distinct(daily, ["key"]).collect()}
    assert abs(got["x"] - 4000) < 200 and abs(got["y"] - 5500) < 275
    made = {r.key: r.sketch for r in sketches.audience_sketches(df, ["key"], "user").collect()}
    one = spark.createDataFrame([(made["x"], made["y"])], "a binary, b binary")
    r = one.select(*[c.alias(n) for n, c in sketches.overlap(F.col("a"), F.col("b")).items()]).first()
    for value, exact in ((r.n_one, 4000), (r.n_two, 5500), (r.n_both, 500), (r.n_either, 9000)):
        assert abs(value - exact) < 0.05 * 9000


def test_pivot_over_common_values_loses_nothing(spark):
    rng = random.Random(4)
    rows = [(f"r{i % 3}", rng.choice(["a"] * 9 + ["b"] * 5 + ["c"] * 3 + [None, "d"]), float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "r string, c string, v double")
    assert kpis.common_values(df, "c", 3) == ["a", "b", "c"]
    wide = kpis.pivot_sum_common(df, "r", "c", "v", 2, "rest")
    assert set(wide.columns) == {"r", "a", "b", "rest"}
    for row in wide.collect():
        assert row.a + row.b + row.rest == sum(v for r, _, v in rows if r == row.r)


def test_common_values_where_none_is_common(spark):
    """All values rare, so the sketch proposes none surely: they are counted; ties in order."""
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(2000)] + [("v0007",), (None,)], "c string")
    assert kpis.common_values(df, "c", 3) == ["v0007", "v0000", "v0001"]
    assert kpis.common_values(df.limit(0), "c", 3) == []
    assert kpis.common_values(df.where("c is null"), "c", 3) == []
