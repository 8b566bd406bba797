"""Queries on the forest: split, scores, evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adquanta.experiments.ranks import roc_area
from adquanta.functions.features import with_features
from adquanta.functions.labels import FIXED_HIGH_CUT, FIXED_MEDIUM_CUT, PRIORITIES
from adquanta.models import forest
from adquanta.session import file_states, stage
from adquanta.sources.files import SCORED_COLUMNS, reuse
from adquanta.sources.tables import CAMPAIGN_TABLES, campaigns, table

from .common import FEATURES, r, registry, rounded

QUERIES, SQL, query = registry()


# Fitted models and feature tables of this session, by table folder and inputs, each
# with the files it was made from.
_FITS: dict = {}


def _fitted(spark: SparkSession, sf_dir: str, drop: tuple[str, ...] = forest.LEAKING) -> tuple[PipelineModel, DataFrame]:
    """A forest trained on the training share of the staged feature table.

    It is fitted once a session, and anew as soon as a file of the tables has changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, drop)
    files = [file_states(spark, f"{sf_dir}/{name}.parquet") for name in CAMPAIGN_TABLES]
    if key not in _FITS or _FITS[key][0] != files:
        used = dict.fromkeys(["ad_id", "roas", *forest.CATEGORICAL, *forest.NUMERIC, forest.LABEL])
        df = stage(with_features(campaigns(spark, sf_dir)).select(*used), "features")
        _FITS[key] = files, forest.forest(drop=drop).fit(df.where(forest.in_train("ad_id"))), df
    return _FITS[key][1:]


@query(f"""WITH {FEATURES}
SELECT ad_id, CAST('0x' || substr(md5('42|' || ad_id), 1, 8) AS BIGINT) / 4294967296e0 < 0.7 AS in_train
FROM feats""")
def split_hash(spark, sf_dir):
    return campaigns(spark, sf_dir).select("ad_id", forest.in_train("ad_id").alias("in_train"))


@query(f"""WITH {FEATURES},
ranked AS (SELECT high_performer AS y,
                  rank() OVER (ORDER BY ctr_cr_product)
                  + (count(*) OVER (PARTITION BY ctr_cr_product) - 1) / 2e0 AS k
           FROM feats WHERE ctr_cr_product IS NOT NULL),
s AS (SELECT sum(k) FILTER (y = 1) AS rs, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p,
             CAST(count(*) FILTER (y = 0) AS DOUBLE) AS q FROM ranked)
SELECT CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives,
       {r('(rs - p * (p + 1) / 2) / (p * q)', 6)} AS auc FROM s""")
def ml_auc_rank(spark, sf_dir):
    """Area under the ROC curve of one fixed score column."""
    base = with_features(campaigns(spark, sf_dir)).select("ctr_cr_product", "high_performer")
    base = stage(base, "scores")
    return rounded(roc_area(base, "ctr_cr_product", "high_performer"), {"auc": 6})


@query(f"""SELECT count(*) AS n, {r('avg(CAST(quality = toxic AS INTEGER))', 6)} AS accuracy,
       {r('(SELECT sum(f * s) / sum(s) FROM (SELECT c, sum(CAST(quality = c AS INTEGER)) AS s, 2e0 * sum(CAST(quality = c AND toxic = c AS INTEGER)) / nullif(sum(CAST(quality = c AS INTEGER)) + sum(CAST(toxic = c AS INTEGER)), 0) AS f FROM labels, (VALUES (0), (1)) v(c) GROUP BY c))', 6)} AS f1
FROM labels""")
def ml_confusion_metrics(spark, sf_dir):
    """Accuracy and weighted F1 of one label column taken as a prediction of another."""
    counts = forest.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(forest.confusion_metrics(counts, "quality", "toxic"), {"accuracy": 6, "f1": 6})


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def ml_confusion(spark, sf_dir):
    return forest.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = stage(forest.predictions(model, df).select(
        *[c for c in SCORED_COLUMNS if c != "priority"]), "scored")
    return forest.prioritised(scored).select(*SCORED_COLUMNS)


def _holdout(model: PipelineModel, test: DataFrame) -> tuple[dict[str, float], int]:
    """Quality on the rows kept from training, and how many could be scored."""
    names = ("high_performer", "rawPrediction", "prediction")
    with reuse(model.transform(test).select(*names)) as predicted:
        return forest.holdout_metrics(predicted), predicted.count()


@query()
def ml_score(spark, sf_dir):
    """Every campaign scored by the forest, with its priority."""
    return _scored(*_fitted(spark, sf_dir))


@query()
def ml_report(spark, sf_dir):
    """The report document of a training run."""
    model, df = _fitted(spark, sf_dir)
    values, _ = _holdout(model, df.where(~forest.in_train("ad_id")))
    top = forest.importances(model, spark, k=5)
    return forest.training_report(df, _scored(model, df), values, top, len(forest.feature_names()))


@query()
def ml_metrics(spark, sf_dir):
    """Hold-out quality and the number of rows scored of all rows."""
    model, df = _fitted(spark, sf_dir)
    test = df.where(~forest.in_train("ad_id"))
    values, scored = _holdout(model, test)
    return test.agg(
        F.count("*").alias("n_total"), F.lit(scored).cast("bigint").alias("n_scored"),
        *[F.lit(v).alias(k) for k, v in values.items()])


@query()
def ml_importance(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir)
    return forest.importances(model, spark)


@query()
def ml_importance_all(spark, sf_dir):
    """The same with the input that restates the label."""
    model, _ = _fitted(spark, sf_dir, ())
    return forest.importances(model, spark, ())


# What SQL can say about the results above ---------------------------------

_USABLE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
                       for c in forest.NUMERIC if c not in forest.LEAKING)


@query(f"""WITH {FEATURES}
SELECT ad_id, true AS in_range, true AS cut_fits FROM feats WHERE {_USABLE}""")
def ml_scored_ids(spark, sf_dir):
    """Which campaigns are scored, that scores lie in [0, 1] and priorities follow the cuts."""
    score = F.col("conv_score")
    wanted = F.when(score >= FIXED_HIGH_CUT, PRIORITIES[0]).when(score >= FIXED_MEDIUM_CUT, PRIORITIES[1]) \
        .otherwise(PRIORITIES[2])
    return _scored(*_fitted(spark, sf_dir)).select(
        "ad_id", score.between(0, 1).alias("in_range"), (F.col("priority") == wanted).alias("cut_fits"))


@query(f"""WITH {FEATURES},
test AS (SELECT *, {_USABLE} AS usable FROM feats
         WHERE NOT CAST('0x' || substr(md5('42|' || ad_id), 1, 8) AS BIGINT) / 4294967296e0 < 0.7)
SELECT count(*) AS n_total, count(*) FILTER (usable) AS n_scored, true AS in_range FROM test""")
def ml_metrics_bounds(spark, sf_dir):
    """Rows of the hold-out share, and that all measures are shares above one half."""
    fits = [F.col(c).between(0.5, 1) for c in ("auc", "accuracy", "f1")]
    return ml_metrics(spark, sf_dir).select("n_total", "n_scored", (fits[0] & fits[1] & fits[2]).alias("in_range"))


@query("SELECT unnest([" + ", ".join(f"'{c}'" for c in forest.feature_names()) + "]) AS feature, true AS not_negative, "
       "1e0 AS total")
def ml_importance_inputs(spark, sf_dir):
    """Every input with an importance; they sum to one."""
    model, _ = _fitted(spark, sf_dir)
    found = forest.importances(model, spark, k=len(forest.feature_names()))
    total = found.agg(F.round(F.sum("importance"), 6)).scalar()
    return found.select("feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("total"))


@query(f"""WITH {FEATURES}
SELECT count(*) AS total_records, count(DISTINCT advertiser) AS advertisers,
       count(*) FILTER (high_performer = 1) AS positive, count(*) FILTER (high_performer = 0) AS negative,
       count(*) FILTER ({_USABLE}) AS scored, true AS levels_add_up FROM feats""")
def ml_report_counts(spark, sf_dir):
    """The counts in the report document."""
    levels = sum((F.col(f"scoring.{p.lower()}_priority") for p in PRIORITIES), F.lit(0))
    return ml_report(spark, sf_dir).select(
        "total_records", "advertisers", "class_balance.positive", "class_balance.negative", "scoring.scored",
        (levels == F.col("scoring.scored")).alias("levels_add_up"))
