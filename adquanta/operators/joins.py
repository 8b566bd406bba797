"""Joins of facts with a derived dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adquanta.session import stage


def join_dimension(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner",
                   staged: bool = False) -> DataFrame:
    """Equi-join of a large table with a dimension that is unique on ``keys``; null equals null.

    The dimension is computed once and staged, unless it already is a table
    (``staged``). Its size in bytes is then known: Spark broadcasts it below
    its own threshold, and otherwise deals both sides anew, so that adaptive
    execution can split a key that holds many facts.
    """
    dim = dim if staged else stage(dim, "dimension")
    named = dim.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                       *[F.col(c) for c in dim.columns if c not in keys])
    on = reduce(lambda a, b: a & b, (facts[k].eqNullSafe(named[f"_key_{k}"]) for k in keys))
    return facts.join(named, on, how).drop(*[f"_key_{k}" for k in keys])


def with_group_mean(df: DataFrame, key: str, value: str, out: str, delta: str | None = None) -> DataFrame:
    """Attach the mean of ``value`` per ``key`` and, if named, the difference to it.

    Rows with a null key have no partner and drop out, as in an inner join.
    """
    means = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(value).alias(out))
    )
    joined = join_dimension(df, means, [key])
    if delta:
        joined = joined.withColumn(delta, F.col(value) - F.col(out))
    return joined
