"""Mergeable sketches: quantiles, distinct counts and overlaps from small binary columns.

A sketch is made once per group (say, a day and a key), kept in a table, and
merged later for any coarser group without the rows. Rows are sketched in their
scan tasks; what is shuffled has the size of a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adquanta.functions.safe import present

KLL_K = 200        # about 1.7 % of the rank, in both directions, at 99 % confidence
HLL_BITS = 12      # 2**12 registers: about 1.6 % standard error
THETA_BITS = 12    # 4096 hashes: about 1.6 % standard error of a sketch that overflows


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """``sketch`` (KLL) of the values of each group; null and NaN are left out."""
    clean = F.when(present(value), F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(clean, F.lit(k)).alias("sketch"))


def merged_quantile_sketches(sketches: DataFrame, keys: list[str], k: int = KLL_K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """Named quantiles and the number of values; null where a group has none."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.withColumns({
        "n": F.kll_sketch_get_n_double("sketch"),
        **{name: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for name, p in points.items()},
    })


def rank_errors(rows: DataFrame, quantiles: DataFrame, keys: list[str], value: str,
                points: dict[str, float]) -> DataFrame:
    """Per group the largest distance of a quantile's exact ranks from the wanted one, as a share of n.

    ``quantiles`` has one row a group and is staged by the caller.
    """
    from .joins import join_dimension

    held = join_dimension(rows.select(*keys, F.col(value).alias("_v")).where(present("_v")), quantiles, keys, staged=True)
    sides = [f(F.col("_v"), F.col(name)) for name in points for f in (lambda v, q: v < q, lambda v, q: v <= q)]
    counted = held.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(s).alias(f"_{i}") for i, s in enumerate(sides)])
    off = []
    for i, p in enumerate(points.values()):
        below, upto = (F.col(f"_{2 * i + j}") / F.col("n") for j in (0, 1))
        off.append(F.greatest(below - F.lit(p), F.lit(p) - upto, F.lit(0.0)))
    return counted.select(*keys, "n", F.greatest(*off, F.lit(0.0)).alias("error"))


def distinct_sketches(df: DataFrame, keys: list[str], value: str, bits: int = HLL_BITS) -> DataFrame:
    """``sketch`` (HyperLogLog) of the distinct values of each group."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct values of coarser groups: union of their sketches."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def audience_sketches(df: DataFrame, keys: list[str], value: str, bits: int = THETA_BITS) -> DataFrame:
    """``sketch`` (theta) of the distinct values of each group, for unions and overlaps."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, F.lit(bits)).alias("sketch"))


def overlap(one: Column, two: Column, bits: int = THETA_BITS) -> dict[str, Column]:
    """Estimated sizes of two audiences, of what they share and of both together."""
    size = F.theta_sketch_estimate
    return {"n_one": size(one), "n_two": size(two), "n_both": size(F.theta_intersection(one, two)),
            "n_either": size(F.theta_union(one, two, F.lit(bits)))}
