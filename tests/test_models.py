import math

import pytest
from pyspark.sql import functions as F

from adquanta.functions.features import with_features
from adquanta.models import forest
from adquanta.operators.scoring import (
    composite_score,
    fixed_priority,
    rescaled,
    sigmoid_margin,
    tercile_priority,
)
from adquanta.sources.tables import campaigns


def test_split_is_stable_and_close_to_its_share(spark):
    df = spark.range(4000).withColumn("t", forest.in_train("id"))
    again = spark.range(4000).repartition(9).withColumn("t", forest.in_train("id"))
    pick = lambda d: sorted(r.id for r in d.where("t").collect())
    assert pick(df) == pick(again)
    assert len(pick(df)) / 4000 == pytest.approx(0.7, abs=0.03)


def test_composite_score_and_terciles(spark):
    rows = [(i, float(i), float(10 - i), 1.0 * i) for i in range(11)] + [(11, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, roas double, ctr_pct double, cr_pct double")
    scored = tercile_priority(composite_score(df))
    got = {r.id: (r.ml_score, r.priority) for r in scored.collect()}
    assert got[10][0] == pytest.approx(0.45 + 0.25, abs=1e-6)
    assert got[0][0] == pytest.approx(0.30, abs=1e-6)
    assert got[11] == (None, "LOW")
    levels = [p for _, p in got.values()]
    assert (levels.count("HIGH"), levels.count("MEDIUM"), levels.count("LOW")) == (4, 3, 5)


def test_score_at_a_tercile_belongs_to_the_upper_class(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.33, 0.66, 1.0)], "s double")
    out = tercile_priority(df, "s", probabilities=(1 / 3, 2 / 3)).collect()
    assert [r.priority for r in out] == ["LOW", "MEDIUM", "HIGH", "HIGH"]


def test_sigmoid_and_rescale(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (None, 1.0)], "a double, b double")
    s = [r[0] for r in df.select(sigmoid_margin(F.col("a"), F.col("b"))).collect()]
    assert s == pytest.approx([0.5, 1 / (1 + math.exp(-2)), 0.5])
    x = spark.createDataFrame([(2.0,), (3.0,), (4.0,)], "x double")
    assert [r[0] for r in rescaled(x, "x").collect()] == [0.0, 0.5, 1.0]
    same = spark.createDataFrame([(0.8,), (0.8,)], "x double")
    out = rescaled(same, "x").select("x", fixed_priority("x").alias("p")).collect()
    assert [tuple(r) for r in out] == [(0.8, "HIGH")] * 2


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    df = with_features(campaigns(spark, sf_dir)).persist()
    model = forest.forest(trees=10, depth=4).fit(df.where(forest.in_train("ad_id")))
    return model, df


def test_forest_beats_chance_and_skips_incomplete_rows(trained):
    model, df = trained
    test = model.transform(df.where(~forest.in_train("ad_id")))
    m = forest.holdout_metrics(test)
    assert m["auc"] > 0.6 and 0 < m["accuracy"] <= 1 and 0 < m["f1"] <= 1
    complete = df.where("platform is not null and clicks_per_day is not null").count()
    assert forest.predictions(model, df).count() == complete < df.count()


@pytest.mark.parametrize("score", ["margin", "probability"])
def test_scores_span_the_unit_interval(trained, score):
    model, df = trained
    out = forest.prioritised(forest.predictions(model, df, score).select("ad_id", "conv_score"))
    r = out.agg(F.min("conv_score"), F.max("conv_score"), F.collect_set("priority")).first()
    assert (r[0], r[1]) == (0.0, 1.0) and {"HIGH", "LOW"} <= set(r[2])


def test_importances_are_ordered(trained, spark):
    rows = forest.importances(trained[0], spark).collect()
    assert len(rows) == 10
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_training_report(trained, spark, tmp_path):
    model, df = trained
    scored = forest.prioritised(forest.predictions(model, df).select("ad_id", "conv_score"))
    values = {"auc": 0.71234, "accuracy": 0.5, "f1": 0.25}
    r = forest.training_report(df, scored, values, forest.importances(model, spark, k=5), 18).first()
    assert r.total_records == r.class_balance.positive + r.class_balance.negative == df.count()
    s = r.scoring
    assert s.high_priority + s.medium_priority + s.low_priority == s.scored == scored.count()
    assert r.metrics.auc == 0.7123 and r.features_count == 18
    top = [f.importance for f in r.top_features]
    assert len(top) == 5 and top == sorted(top, reverse=True)


def test_leaking_inputs_can_be_left_out():
    names = forest.feature_names(())
    assert len(names) == 18
    assert forest.feature_names() == forest.feature_names(forest.LEAKING)
    assert set(names) - set(forest.feature_names(forest.LEAKING)) == {"cost_efficiency"}


def test_confusion_metrics_agree_with_the_library(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Evaluator

    rows = [(float(i % 3 == 0), float(i % 4 == 0 or i % 7 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "y double, p double")
    r = forest.confusion_metrics(forest.confusion(df, "y", "p"), "y", "p").first()
    for name, value in (("accuracy", r.accuracy), ("f1", r.f1)):
        ev = Evaluator(labelCol="y", predictionCol="p", metricName=name)
        assert value == pytest.approx(ev.evaluate(df))
    assert r.n == 100
