"""Tables that the batches of a stream write, each batch its own part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from adquanta.session import folder_names, remove_path


@dataclass
class BatchTable:
    """Rows of many batches under one folder; a repeated batch replaces its own rows.

    Every ``every`` batches those that can no longer be repeated are merged into
    one part, so a long stream leaves a bounded number of folders. A merged part
    counts once it is complete; what it holds is removed a merge later, when no
    reader of the parts before is left.
    """

    path: str
    every: int = 20

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if batch_id and batch_id % self.every == 0:
            self._merge(rows.sparkSession, batch_id - 2)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """All rows of the batches so far, or of those up to ``upto``."""
        return spark.read.parquet(*self._parts(spark, upto))

    def _parts(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        merged, batches = self._numbers(spark)
        done = max((n for n in merged if upto is None or n <= upto), default=-1)
        later = sorted(n for n in batches if n > done and (upto is None or n <= upto))
        return ([f"{self.path}/upto={done}"] if done >= 0 else []) + [f"{self.path}/batch={n}" for n in later]

    def _numbers(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        """Ends of the complete merged parts, and numbers of the single batches."""
        names = folder_names(spark, self.path)
        batches = [int(n[6:]) for n in names if n.startswith("batch=")]
        ends = [int(n[5:]) for n in names if n.startswith("upto=")]
        return [n for n in ends if "_SUCCESS" in folder_names(spark, f"{self.path}/upto={n}")], batches

    def _merge(self, spark: SparkSession, upto: int) -> None:
        merged, batches = self._numbers(spark)
        before = max((n for n in merged if n < upto), default=-1)
        if upto not in merged:   # a repeated batch finds its merge done
            self.read(spark, upto).write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        for n in batches:
            if n <= before:
                remove_path(spark, f"{self.path}/batch={n}")
        for n in merged:
            if n < before:
                remove_path(spark, f"{self.path}/upto={n}")
