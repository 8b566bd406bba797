"""Campaign and event files: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from adquanta.schemas import BENCHMARK_EVENT, CAMPAIGN


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header row and a fixed schema; a leading byte-order mark is dropped."""
    return spark.read.schema(schema).csv(path, header=True, encoding="UTF-8")


def read_campaigns(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CAMPAIGN)


def read_benchmark_events(spark: SparkSession, path: str,
                          partitions: int | None = None) -> DataFrame:
    """Event file; a partition count forces a shuffle and is best left out."""
    df = read_csv(spark, path, BENCHMARK_EVENT)
    return df.repartition(partitions) if partitions else df


def register_view(df: DataFrame, name: str = "ads") -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV folder with a header in each file, written by all tasks."""
    df.write.mode(mode).csv(path, header=True, encoding="UTF-8")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested rows as JSON lines, written by all tasks."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report of one row as one document in one file."""
    write_json(df.limit(1).coalesce(1), path, mode)


# Columns of the scored-campaign file, in order.
SCORED_COLUMNS = ("ad_id", "advertiser", "platform", "target_age", "target_gender",
                  "ctr_pct", "cr_pct", "cac", "roas", "conv_score", "priority")


def write_scored(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(df.select(*SCORED_COLUMNS), path, mode)


class reuse:
    """Keep a DataFrame that is read several times, and release it afterwards.

    ``with reuse(df) as kept: ...`` spills to disk when memory is short.
    Actions on ``kept`` belong inside the block.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def __enter__(self) -> DataFrame:
        return self.df.persist()

    def __exit__(self, *_) -> None:
        self.df.unpersist()
