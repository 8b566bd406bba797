"""Streaming queries: running funnel, ingestion, count and time windows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from adquanta.operators.joins import join_dimension
from adquanta.operators.positions import with_position
from adquanta.session import remove_path

from .batches import BatchTable
from .funnel import COUNTERS, funnel_counters, time_windows, with_ratios
from .windows import ORDER, WINDOW_SIZE, merge_windows, window_counts, with_window_ctr

WATERMARK = "10 minutes"


def start_ingest(events: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Append events to files under ``path``; exactly once by the file sink's log."""
    return (
        events.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def ingested(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def start_running_funnel(events: DataFrame, path: str, *keys: str, **trigger) -> StreamingQuery:
    """Counters per key over all events so far; each batch writes a version.

    State and versions have one row per key. A repeated batch overwrites its
    own version, so restarts do not count twice.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")
        # A reader may still use the version before; older ones are done with.
        remove_path(batch.sparkSession, f"{path}/versions/batch={batch_id - 2}")

    return (
        funnel_counters(events, *keys).writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def running_funnel(spark, path: str, cac_when_empty: float | None = None) -> DataFrame:
    """The newest version of a running funnel, best return first."""
    versions = spark.read.parquet(f"{path}/versions")
    newest = versions.agg(F.max("batch")).scalar()
    return with_ratios(versions.where(F.col("batch") == newest).drop("batch"),
                       cac_when_empty).orderBy(F.desc("roas"), *[c for c in versions.columns if c not in (*COUNTERS, "batch")])


def start_time_windows(events: DataFrame, path: str, size: str, slide: str | None = None,
                       keys: tuple[str, ...] = (), watermark: str = WATERMARK,
                       **trigger) -> StreamingQuery:
    """Append event-time windows to files once the watermark has passed them."""
    windows = time_windows(events, size, slide, keys, watermark)
    return start_ingest(windows, path, **trigger)


def time_window_states(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Event-time windows that the stream under ``path`` still holds in its state.

    Read from the state store of the last committed batch; the stream need not
    run. Counters lie in the state in the order of the aggregate's columns.
    """
    held = spark.read.format("statestore").load(f"{path}/checkpoint")
    long = ", ".join(f"{c} {'double' if c in ('revenue', 'cost') else 'bigint'}" for c in COUNTERS)
    names = ", ".join(["window struct<start: timestamp, end: timestamp>",
                       *[f"{k} {held.schema['key'].dataType[i + 1].dataType.simpleString()}" for i, k in enumerate(keys)]])
    row = held.select(F.col("key").cast(f"struct<{names}>").alias("key"), F.col("value").cast(f"struct<{long}>").alias("value"))
    counters = [F.coalesce(F.col(f"value.{c}"), F.lit(0)).alias(c) for c in COUNTERS]
    return row.select(F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end"),
                      *[F.col(f"key.{k}").alias(k) for k in keys], *counters)


def all_time_windows(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every window of a stream: those that the watermark has closed and those still open."""
    closed = ingested(spark, path).withColumn("closed", F.lit(True))
    return closed.unionByName(time_window_states(spark, path, keys).withColumn("closed", F.lit(False)))


def start_count_windows(events: DataFrame, path: str, keys: list[str], size: int = WINDOW_SIZE,
                        order: list[str] = ORDER, **trigger) -> StreamingQuery:
    """Fixed-size windows per key in order of arrival, and by ``order`` in a batch.

    A per-key state function would take a hot key's events one by one in a
    single task. Here each batch numbers its rows in range slices, adds the
    number of events seen before, and writes partial windows, which
    :func:`counted_windows` adds up. Batch ``n`` reads the totals of batch
    ``n - 1`` and overwrites its own output, so a repeated batch is harmless.
    """
    used = events.select(*dict.fromkeys([*keys, *order, "event_type"]))

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = with_position(batch, order, keys, "_in_batch")
        here = rows.groupBy(*keys).agg(F.count("*").alias("seen"))
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/seen/{batch_id - 1}")
            rows = join_dimension(rows, before, keys, "left", staged=True)
            here = here.unionByName(before).groupBy(*keys).agg(F.sum("seen").alias("seen"))
        else:
            rows = rows.withColumn("seen", F.lit(0))
        position = F.col("_in_batch") + F.coalesce(F.col("seen"), F.lit(0))
        partial = window_counts(rows.withColumn("position", position), size, keys)
        here.write.mode("overwrite").parquet(f"{path}/seen/{batch_id}")
        BatchTable(f"{path}/windows").write(partial, batch_id)
        # A repeated batch reads the totals of the one before.
        remove_path(spark, f"{path}/seen/{batch_id - 2}")

    return (
        used.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def counted_windows(spark, path: str, keys: list[str]) -> DataFrame:
    return with_window_ctr(merge_windows(BatchTable(f"{path}/windows").read(spark), keys))


def finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


class ProgressLog(StreamingQueryListener):
    """Appends a row to a table for every batch of every stream: rows, rates, observed numbers.

    Spark itself keeps the progress of recent batches alone. Numbers that a
    stream observes (``DataFrame.observe``) are kept as a map of text. Register
    with ``spark.streams.addListener``.
    """

    SCHEMA = ("query string, run string, batch_id bigint, input_rows bigint, input_rate double, "
              "processed_rate double, observed map<string, string>")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = {name: str(value) for row in p.observedMetrics.values() for name, value in row.asDict().items()}
        row = (str(p.id), str(p.runId), p.batchId, p.numInputRows, float(p.inputRowsPerSecond or 0),
               float(p.processedRowsPerSecond or 0), observed)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        # Events of a query arrive in order, so its progress is written by now.
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all progress of an ended query is in the table."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError(f"no end of query {query.runId} was reported")
            time.sleep(0.05)

    def rows(self) -> DataFrame:
        """The progress so far; a batch that was repeated after a failure counts once, in its last form."""
        logged = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return logged.groupBy("query", "batch_id").agg(
            *[F.max(c).alias(c) for c in ("input_rows", "input_rate", "processed_rate")],
            F.max_by("observed", "input_rows").alias("observed"))


def progress(query: StreamingQuery) -> DataFrame:
    """Rows and rates of the recent batches, as many as Spark retains."""
    from pyspark.sql import SparkSession

    rows = [(p["batchId"], p["numInputRows"], float(p.get("inputRowsPerSecond", 0.0) or 0.0),
             float(p.get("processedRowsPerSecond", 0.0) or 0.0)) for p in query.recentProgress]
    return SparkSession.active().createDataFrame(
        rows, "batch_id bigint, input_rows bigint, input_rate double, processed_rate double")
