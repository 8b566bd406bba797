"""Random forest over campaign features: training, evaluation, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.functions.labels import PRIORITIES
from adquanta.operators.scoring import fixed_priority, rescaled, sigmoid_margin

# Model inputs in order.
NUMERIC = ("impressions", "clicks", "ctr_pct", "cr_pct", "spent", "cpc", "cac", "duration_days",
           "budget_utilization", "clicks_per_day", "spend_per_impression", "is_multi_platform",
           "ctr_cr_product", "cost_efficiency")
CATEGORICAL = ("advertiser", "platform", "target_age", "target_gender")
# Inputs that restate the label when return is revenue over spend.
LEAKING = ("cost_efficiency",)
LABEL = "high_performer"


def in_train(row_id: Column | str, fraction: float = 0.7, seed: int = 42) -> Column:
    """Split by a digest of the id: stable under any partitioning or retry."""
    key = F.concat_ws("|", F.lit(seed), F.col(row_id) if isinstance(row_id, str) else row_id)
    uniform = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    return uniform < fraction


def feature_names(drop: Sequence[str] = LEAKING) -> list[str]:
    return [c for c in (*NUMERIC, *(f"{c}_idx" for c in CATEGORICAL)) if c not in drop]


def forest(trees: int = 100, depth: int = 8, min_rows: int = 3, seed: int = 42,
           drop: Sequence[str] = LEAKING) -> Pipeline:
    """Index, assemble, standardise, classify. Rows with a missing input are skipped.

    Inputs that restate the label are left out; ``drop=()`` takes them in.
    """
    index = StringIndexer(inputCols=list(CATEGORICAL), handleInvalid="keep",
                          outputCols=[f"{c}_idx" for c in CATEGORICAL])
    assemble = VectorAssembler(inputCols=feature_names(drop), outputCol="features",
                               handleInvalid="skip")
    scale = StandardScaler(inputCol="features", outputCol="scaled_features",
                           withMean=True, withStd=True)
    classify = RandomForestClassifier(
        featuresCol="scaled_features", labelCol=LABEL, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_rows, seed=seed, maxMemoryInMB=1024)
    return Pipeline(stages=[index, assemble, scale, classify])


def holdout_metrics(predictions: DataFrame) -> dict[str, float]:
    """Area under ROC, accuracy and weighted F1."""
    def multiclass(metric: str) -> float:
        return MulticlassClassificationEvaluator(
            labelCol=LABEL, predictionCol="prediction", metricName=metric).evaluate(predictions)

    area = BinaryClassificationEvaluator(
        labelCol=LABEL, rawPredictionCol="rawPrediction",
        metricName="areaUnderROC").evaluate(predictions)
    return {"auc": area, "accuracy": multiclass("accuracy"), "f1": multiclass("f1")}


def importances(model: PipelineModel, spark, drop: Sequence[str] = LEAKING, k: int = 10) -> DataFrame:
    """The ``k`` largest feature importances; one row per model input at most."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(feature_names(drop), values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(k)


def predictions(model: PipelineModel, df: DataFrame, score: str = "margin") -> DataFrame:
    """Add ``conv_score`` before rescaling.

    ``"margin"`` squashes the difference of the class votes, which saturates
    for many trees; ``"probability"`` is the share of votes.
    """
    out = model.transform(df)
    if score == "margin":
        raw = vector_to_array("rawPrediction")
        value = sigmoid_margin(raw[0], raw[1])
    elif score == "probability":
        value = vector_to_array("probability")[1]
    else:
        raise ValueError(f"unknown score: {score}")
    return out.withColumn("conv_score", value)


def prioritised(scored: DataFrame) -> DataFrame:
    """Stretch the score to [0, 1] and label it with the fixed cuts.

    Reads ``scored`` twice; stage it when it is the output of a model.
    """
    return rescaled(scored, "conv_score").withColumn("priority", fixed_priority("conv_score"))


def training_report(df: DataFrame, scored: DataFrame, metrics: dict[str, float],
                    top: DataFrame, features: int) -> DataFrame:
    """One document: size, class balance, quality, priorities, leading features.

    ``top`` is a result of :func:`importances`, bounded by the model's inputs.
    """
    rows = df.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("advertiser").alias("advertisers"),
        F.struct(F.count_if(F.col(LABEL) == 1).alias("positive"),
                 F.count_if(F.col(LABEL) == 0).alias("negative")).alias("class_balance"),
    )
    levels = scored.agg(F.struct(
        F.count("*").alias("scored"),
        *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_priority") for p in PRIORITIES],
    ).alias("scoring"))
    leading = top.agg(F.array_sort(F.collect_list(F.struct(
        (-F.round("importance", 4)).alias("order"), "feature", F.round("importance", 4).alias("importance")
    ))).alias("found")).select(F.transform("found", lambda e: F.struct(
        e["feature"].alias("feature"), e["importance"].alias("importance"))))
    return rows.select(
        "total_records", "advertisers", "class_balance",
        F.lit(features).alias("features_count"),
        F.struct(*[F.lit(round(v, 4)).alias(k) for k, v in metrics.items()]).alias("metrics"),
        levels.scalar().alias("scoring"),
        leading.scalar().alias("top_features"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def confusion_metrics(counts: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and weighted F1 from confusion counts, one row per class pair."""
    n = F.col("n")
    classes = counts.select(
        "n", F.inline(F.array(
            F.struct(F.col(label).alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("said")),
            F.struct(F.col(prediction).alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("said")),
        )), (F.col(label) == F.col(prediction)).alias("right"))
    per_class = classes.groupBy("class").agg(
        F.sum(n * F.col("actual")).alias("support"),
        F.sum(n * F.col("said")).alias("predicted"),
        F.sum(F.when(F.col("right"), n * F.col("actual")).otherwise(0)).alias("correct"),
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("correct"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class.agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("correct"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1"),
    )
