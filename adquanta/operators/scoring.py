"""Composite scores and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.functions.labels import FIXED_HIGH_CUT, FIXED_MEDIUM_CUT, PRIORITIES, priority
from adquanta.functions.safe import min_max, present

from .quantiles import exact_quantiles

# Weights, tercile probabilities and the guard of the rescaling.
WEIGHTS = {"roas": 0.45, "ctr_pct": 0.30, "cr_pct": 0.25}
TERCILES = (0.33, 0.66)
EPSILON = 1e-9


def normalised(df: DataFrame, columns: list[str], suffix: str = "_norm",
               epsilon: float = EPSILON) -> DataFrame:
    """Min-max rescaled columns; one aggregate finds the ends of all of them.

    NaN is missing: it is no end, and its rescaled value is null.
    """
    known = {c: F.when(present(c), F.col(c)) for c in columns}
    ends = df.agg(F.struct(*[
        e.alias(f"{c}_{end}") for c, v in known.items()
        for end, e in (("lo", F.min(v)), ("hi", F.max(v)))
    ])).scalar()
    return df.withColumns({
        c + suffix: min_max(v, ends[f"{c}_lo"], ends[f"{c}_hi"], epsilon)
        for c, v in known.items()
    })


def composite_score(df: DataFrame, weights: dict[str, float] = WEIGHTS,
                    out: str = "ml_score") -> DataFrame:
    """Weighted sum of min-max rescaled columns; null when one is missing."""
    df = normalised(df, list(weights))
    score = sum((F.lit(w) * F.col(f"{c}_norm") for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, score)


def tercile_priority(df: DataFrame, score: str = "ml_score", out: str = "priority",
                     probabilities: tuple[float, float] = TERCILES,
                     labels: tuple[str, str, str] = PRIORITIES) -> DataFrame:
    """Priority by the exact 0.33 and 0.66 quantiles of the score."""
    low, high = exact_quantiles(df, score, list(probabilities))
    return df.withColumn(out, priority(score, F.lit(high), F.lit(low), labels))


def fixed_priority(score: str = "conv_score", high: float = FIXED_HIGH_CUT,
                   medium: float = FIXED_MEDIUM_CUT) -> Column:
    return priority(score, F.lit(high), F.lit(medium))


def sigmoid_margin(raw0: Column, raw1: Column, missing: float = 0.5) -> Column:
    """Logistic function of the margin between two class scores."""
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw1 - raw0))), F.lit(missing))


def rescaled(df: DataFrame, score: str) -> DataFrame:
    """Stretch a score to [0, 1]; a constant score stays as it is, NaN becomes null."""
    known = F.when(present(score), F.col(score))
    ends = df.agg(F.struct(F.min(known).alias("lo"), F.max(known).alias("hi"))).scalar()
    return df.withColumn(score, min_max(known, ends["lo"], ends["hi"]))
