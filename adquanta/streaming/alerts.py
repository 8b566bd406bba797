"""Alerts that leave a running stream of events, once each.

Windows of a fixed number of events are counted per key. A window is judged as
soon as it is full, or once its key has been quiet for some time. The state
that passes from batch to batch is a table with one row per key: events seen,
the open window's counts, the last time, and how many alerts the key has had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adquanta.operators.joins import join_dimension
from adquanta.operators.positions import with_position
from adquanta.session import folder_names, remove_path, stage

from .batches import BatchTable
from .windows import LOW_CTR, MIN_TOTAL, ORDER, WINDOW_SIZE, merge_windows, window_counts, with_window_ctr
from .windows import alerts as judged

_COUNTS = ("total", "clicks", "conversions")


def start_alerts(events: DataFrame, path: str, keys: list[str], size: int = WINDOW_SIZE,
                 low_ctr: float = LOW_CTR, min_total: int = MIN_TOTAL, idle: str | None = None,
                 order: list[str] = ORDER, time: str = "ts", every: int = 20, **trigger) -> StreamingQuery:
    """Write alerts of full windows, numbered from 1 per key, as they arise.

    ``idle`` is an interval such as ``"30 minutes"``: a window whose key has
    had no event for longer, by the latest event time of the stream, is judged
    as it is, and the key's next event opens a new window. Quiet keys are rows
    of the state, so no event of theirs is needed. Batch ``n`` reads the state
    of batch ``n - 1`` and replaces its own output, so a repeated batch after a
    restart adds nothing. Rows of a batch are numbered in range slices: a hot
    key is spread over tasks, and no task holds more than a slice.
    """
    used = events.select(*dict.fromkeys([*keys, *order, time, "event_type"]))
    fired, windows = BatchTable(f"{path}/alerts", every), BatchTable(f"{path}/windows", every)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = with_position(batch, order, keys, "_in_batch")
        news = rows.groupBy(*keys).agg(F.count("*").alias("_new"), F.max(time).alias("_time"))
        before = spark.read.parquet(f"{path}/open/{batch_id - 1}") if batch_id else _no_state(spark, batch, keys, time)
        rows = join_dimension(rows, before.select(*keys, "seen"), keys, "left", staged=True)
        position = F.col("_in_batch") + F.coalesce("seen", F.lit(0))
        counted = window_counts(rows.withColumn("position", position), size, keys)
        kept = before.where("total > 0").select(*keys, F.col("window"), *_COUNTS)
        merged = stage(merge_windows(counted.unionByName(kept), keys), "windows")

        state = _outer(before.drop("window", *_COUNTS), news, keys).select(
            *keys, (F.coalesce("seen", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("seen"),
            F.greatest("last", "_time").alias("last"), F.coalesce("fired", F.lit(0)).alias("fired"), "clock")
        clock = F.greatest(*[F.lit(x).cast(batch.schema[time].dataType) for x in (before.agg(F.max("clock")).first()[0], batch.agg(F.max(time)).first()[0])])
        open_ = merged.where(F.col("total") < size)
        state = stage(_outer(state, open_, keys).withColumn("clock", clock), "state")
        quiet = F.lit(False) if idle is None else F.coalesce(
            F.col("last") + F.expr(f"interval {idle}") < F.col("clock"), F.lit(False))
        flushed = state.where((F.col("total") > 0) & quiet)
        full = merged.where(F.col("total") == size)
        closed = stage(full.select(*keys, "window", *_COUNTS).unionByName(
            flushed.select(*keys, "window", *_COUNTS)), "closed")
        windows.write(closed, batch_id)

        alerts = judged(with_window_ctr(closed), low_ctr, min_total)
        placed = with_position(alerts, ["window", "type"], keys, "_place")
        known = state.select(*keys, "fired")
        out = stage(join_dimension(placed, known, keys, "left", staged=True).withColumn(
            "number", F.col("_place") + F.coalesce("fired", F.lit(0))).drop("_place", "fired"), "alerts")
        fired.write(out, batch_id)

        added = out.groupBy(*keys).agg(F.count("*").alias("_more"))
        # A key whose short window went out goes on at the start of the next one.
        ended = (F.col("total") > 0) & quiet
        seen = F.when(ended, F.ceil(F.col("seen") / size).cast("bigint") * size).otherwise(F.col("seen"))
        nothing = [F.when(~ended, F.col(c)).alias(c) for c in ("window", *_COUNTS)]
        join_dimension(state, added, keys, "left").select(
            *keys, seen.alias("seen"), "last", (F.col("fired") + F.coalesce("_more", F.lit(0))).alias("fired"),
            "clock", *nothing).write.mode("overwrite").parquet(f"{path}/open/{batch_id}")
        # A repeated batch reads the state of the one before.
        remove_path(spark, f"{path}/open/{batch_id - 2}")

    return (
        used.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _no_state(spark: SparkSession, batch: DataFrame, keys: list[str], time: str) -> DataFrame:
    stamp = F.lit(None).cast(batch.schema[time].dataType)
    long = lambda c: F.lit(None).cast("bigint").alias(c)
    return batch.limit(0).select(
        *keys, long("seen"), stamp.alias("last"), long("fired"), stamp.alias("clock"), long("window"),
        *[long(c) for c in _COUNTS])


def _outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join on the keys, null equal to null; both have one row per key."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.lit(True).alias("_right"),
                         *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_r_{k}"])
    here = left.withColumn("_left", F.lit(True))
    joined = here.join(named, on, "full")
    return joined.select(
        *[F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys],
        *[c for c in (*left.columns, *right.columns) if c not in keys])


def fired_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of closed windows, with their number per key."""
    return BatchTable(f"{path}/alerts").read(spark)


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    """Full windows and those of quiet keys, with their counts and CTR."""
    return with_window_ctr(BatchTable(f"{path}/windows").read(spark))


def open_alerts(spark: SparkSession, path: str, keys: list[str], low_ctr: float = LOW_CTR,
                min_total: int = MIN_TOTAL) -> DataFrame:
    """Alerts that the windows still open would give if the stream ended now."""
    newest = max(int(n) for n in _states(spark, path))
    state = spark.read.parquet(f"{path}/open/{newest}").where("total > 0")
    return judged(with_window_ctr(state.select(*keys, "window", *_COUNTS)), low_ctr, min_total)


def _states(spark: SparkSession, path: str) -> list[str]:
    return [n for n in folder_names(spark, f"{path}/open")
            if "_SUCCESS" in folder_names(spark, f"{path}/open/{n}")]
