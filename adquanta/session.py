"""Session settings and the shared folder used for staged data."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "adquanta", master: str | None = None,
                  **settings: str) -> SparkSession:
    """Session with the settings the operators rely on.

    Shuffle partition counts and memory are left to the cluster; adaptive
    execution coalesces and splits shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to all executors.

    A session without that setting uses a folder in its warehouse, which all
    executors see as well; no folder of one machine is ever chosen.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a DataFrame that several passes read to the shared folder once.

    The passes then scan columnar files with pruning and filter pushdown in
    place of repeating the joins behind ``df``, and survive executor loss.
    Select the needed columns before staging. The shuffle files behind ``df``
    are of no more use then; Spark removes them once the driver has collected
    the plan that made them. It lets go of a plan when the next job has run, so
    one row is read before the collection is asked for.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    schema = df.schema
    del df
    staged = spark.read.schema(schema).parquet(path)
    staged.head(1)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    staged.staged_path = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that no later result reads."""
    path = getattr(staged, "staged_path", None)
    if path:
        remove_path(staged.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark keeps it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, wherever Spark keeps it; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of every file below a path; a changed table has another list."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], store.listFiles(where, True)
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)
