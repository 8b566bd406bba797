"""The two-sample test as a table function for SQL.

``SELECT * FROM two_sample_test(TABLE(arms))`` takes one row per hypothesis and
arm, with size, mean and sample deviation, so that a partition of the function
is two rows however many there are behind them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

NEEDED = ("arm", "n", "mean", "std")


class TwoSampleTest:
    """Welch's t and Cohen's d of arms ``a`` and ``b`` of each hypothesis.

    All columns of the argument but arm, n, mean and std name the hypothesis; rows
    are partitioned by them. ``alpha`` is an optional second argument. An arm
    that is missing or has fewer than two values gives nulls.
    """

    def __init__(self) -> None:
        self.arms: dict = {}
        self.names: dict = {}
        self.alpha = 0.05

    @staticmethod
    def analyze(arms: AnalyzeArgument, alpha: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not arms.isTable:
            raise ValueError("two_sample_test takes a table: two_sample_test(TABLE(...))")
        lacking = [c for c in NEEDED if c not in arms.dataType.names]
        if lacking:
            raise ValueError(f"two_sample_test needs the columns {', '.join(lacking)}")
        if alpha is not None and not (alpha.isConstantExpression and 0 < float(alpha.value) < 1):
            raise ValueError("alpha must be a constant between 0 and 1")
        keys = [f for f in arms.dataType.fields if f.name not in NEEDED]
        out = StructType([*keys]).add("n_a", LongType()).add("n_b", LongType())
        for name in ("mean_a", "mean_b", "cohens_d", "t_statistic", "welch_df", "p_value"):
            out = out.add(name, DoubleType())
        return AnalyzeResult(schema=out.add("significant", BooleanType()),
                             partitionBy=[PartitioningColumn(k.name) for k in keys])

    def eval(self, arms: Row, alpha: float = 0.05) -> None:
        self.names = {k: v for k, v in arms.asDict().items() if k not in NEEDED}
        self.arms[arms["arm"]] = arms
        self.alpha = float(alpha)

    def terminate(self) -> Iterator[tuple]:
        if self.arms:
            yield (*self.names.values(), *self._test(self.arms.get("a"), self.arms.get("b")))

    def _test(self, a: Row | None, b: Row | None) -> tuple:
        import numpy as np

        from adquanta.experiments.pvalues import student_two_sided

        sizes = tuple(x["n"] if x else 0 for x in (a, b))
        means = tuple(x["mean"] if x else None for x in (a, b))
        if min(sizes) < 2:
            return (*sizes, *means, None, None, None, None, False)
        (n_a, n_b), diff = sizes, means[0] - means[1]
        pooled = math.sqrt(((n_a - 1) * a["std"] ** 2 + (n_b - 1) * b["std"] ** 2) / (n_a + n_b - 2))
        d = diff / pooled if pooled else 0.0
        share_a, share_b = a["std"] ** 2 / n_a, b["std"] ** 2 / n_b
        error = math.sqrt(share_a + share_b)
        if error:
            t = diff / error
            df = (share_a + share_b) ** 2 / (share_a**2 / (n_a - 1) + share_b**2 / (n_b - 1))
        elif diff:
            t, df = math.copysign(math.inf, diff), 1.0
        else:
            return (*sizes, *means, d, None, 1.0, None, False)
        p = float(student_two_sided(np.array([t]), np.array([df]))[0])
        return (*sizes, *means, d, t, df, p, p < self.alpha)


def register_two_sample_test(spark: SparkSession, name: str = "two_sample_test") -> None:
    """Make the function known to SQL of this session."""
    spark.udtf.register(name, F.udtf(TwoSampleTest))


def arm_rows(long: DataFrame, keys: list[str], value: str = "value", arm: str = "arm") -> DataFrame:
    """One row per hypothesis and arm: its size, mean and sample deviation."""
    return long.where(F.col(value).isNotNull()).groupBy(*keys, F.col(arm).alias("arm")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
