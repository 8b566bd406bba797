"""Bag of little bootstraps: intervals of any statistic without a row per replicate."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .bootstrap import PRIME, _interval, _steps, row_numbers

BAG_ROWS = 5000   # rows of a bag in the mean
REPLICATES = 100  # resamples of each bag

# Columns of a bag (rows x columns) and weights (rows x replicates) to one number a replicate.
Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]


def poisson_weights(mean: float) -> tuple[int, np.ndarray]:
    """The smallest weight k and uniform integers whose i-th is the limit of a weight of k + i."""
    away = 12 * math.sqrt(mean) + 20
    low, high = max(0, math.ceil(mean - away)), math.ceil(mean + away)
    logs = [k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(low, high + 1)]
    return low, np.floor(np.cumsum(np.exp(logs)) * PRIME).astype(np.int64)


def trimmed_mean(share: float = 0.1) -> Statistic:
    """Mean of the first column without that share of the weight at either end."""
    def statistic(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        order = np.argsort(columns[:, 0])
        value, weight = columns[order, 0], weights[order]
        upto = np.cumsum(weight, axis=0)
        total = upto[-1]
        kept = np.minimum(upto, (1 - share) * total) - np.maximum(upto - weight, share * total)
        kept = np.maximum(kept, 0)
        return value @ kept / kept.sum(axis=0)
    return statistic


def ratio_of_sums(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the first column over the sum of the second."""
    return columns[:, 0] @ weights / (columns[:, 1] @ weights)


def bag_statistics(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], statistic: Statistic,
                   replicates: int = REPLICATES, bag_rows: int = BAG_ROWS, row_id: str = "row_id",
                   seed: int = 0) -> DataFrame:
    """``stats``, the statistic in each replicate, per (keys, ``bag``).

    The rows of a key are dealt by a digest of their id into as many bags as
    ``bag_rows`` goes into them. Each bag stands for the whole key: its rows get
    Poisson weights that add up to about the key's number of rows. A task
    thus holds one bag, whose size does not grow with the table, and a row is
    shuffled once, not once a replicate. Weights depend on the id alone. Rows
    with a missing column are left out; an undefined statistic is null. Ids must
    tell rows apart, as all rows of an id are in one bag. The number of distinct
    keys must be bounded, as that of arms is.
    """
    keys, columns = list(keys), list(columns)
    full = rows.dropna(subset=columns)
    # One row per arm of a declared hypothesis.
    sizes = full.groupBy(*keys).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    x, y = row_numbers(F.col(f"l.{row_id}"))
    deal = F.conv(F.substring(F.md5(F.col(f"l.{row_id}")), 15, 7), 16, 10).cast("bigint")
    dealt = full.alias("l").join(F.broadcast(sizes.alias("r")), same).select(
        *[F.col(f"l.{k}") for k in keys],
        (deal % F.ceil(F.col("_n") / bag_rows)).alias("bag"), "_n", x.alias("_x"), y.alias("_y"),
        *[F.col(f"l.{c}").cast("double").alias(c) for c in columns])
    p, q = (np.array(s, dtype=np.int64) for s in _steps(replicates, seed))

    def resample(key: tuple, bag: pd.DataFrame) -> pd.DataFrame:
        u = np.multiply.outer(bag["_x"].to_numpy(np.int64), p)
        u += np.multiply.outer(bag["_y"].to_numpy(np.int64), q)
        u %= PRIME
        low, limits = poisson_weights(bag["_n"].iloc[0] / len(bag))
        weights = low + np.searchsorted(limits, u, "right").astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.asarray(statistic(bag[columns].to_numpy(np.float64), weights), np.float64)
        stats = [v if math.isfinite(v) else None for v in found.tolist()]
        return pd.DataFrame({**{k: [v] for k, v in zip([*keys, "bag"], key)}, "stats": [stats]})

    schema = StructType([*[dealt.schema[k] for k in [*keys, "bag"]],
                         StructField("stats", ArrayType(DoubleType()))])
    return dealt.groupBy(*keys, "bag").applyInPandas(resample, schema)


def bag_intervals(stats: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of each bag, averaged over the bags of a key: ``lower`` and ``upper``."""
    per_bag = stats.select(*keys, "bag", F.explode("stats").alias("stat")).groupBy(*keys, "bag").agg(
        _interval("stat", level).alias("_ci"))
    return per_bag.groupBy(*keys).agg(
        F.avg(F.col("_ci")[0]).alias("lower"), F.avg(F.col("_ci")[1]).alias("upper"),
        F.count("*").alias("bags"))
