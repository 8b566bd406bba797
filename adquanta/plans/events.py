"""Queries on ad events: funnels, windows, alerts, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adquanta.operators import sketches
from adquanta.operators.joins import join_dimension
from adquanta.schemas import AD_EVENT
from adquanta.session import fresh_path, stage
from adquanta.sources import topics
from adquanta.sources.tables import ad_events, as_ad_events, table
from adquanta.streaming import run
from adquanta.streaming.alerts import fired_alerts, open_alerts, start_alerts
from adquanta.streaming.funnel import (
    funnel_counters,
    funnel_report,
    merge_counters,
    time_windows,
)
from adquanta.streaming.windows import alerts as alert_rows
from adquanta.streaming.windows import count_windows as windows_of
from adquanta.streaming.windows import last_alerts

from .common import AD_EVENTS, r, registry, rounded

QUERIES, SQL, query = registry()

# Window size and alert limits that suit the supplied events, whose types are
# equally frequent.
SIZE = 10
LIMITS = {"low_ctr": 15.0, "min_total": 5}

_COUNTERS = f"""count(*) FILTER (event_type = 'impression') AS impressions,
       count(*) FILTER (event_type = 'click') AS clicks,
       count(*) FILTER (event_type = 'conversion') AS conversions,
       count(*) FILTER (event_type = 'bounce') AS bounces,
       {r("coalesce(sum(revenue) FILTER (event_type = 'conversion'), 0)", 4)} AS revenue,
       {r('sum(cost)', 4)} AS cost, count(*) AS events"""
_CENTS = {"revenue": 4, "cost": 4}

_TIME = "%Y-%m-%d %H:%M:%S"

_FUNNEL = f"""WITH {AD_EVENTS},
f AS (SELECT advertiser, count(*) FILTER (event_type = 'impression') AS impressions,
             count(*) FILTER (event_type = 'click') AS clicks,
             count(*) FILTER (event_type = 'conversion') AS conversions,
             count(*) FILTER (event_type = 'bounce') AS bounces, count(*) AS events,
             sum(revenue) AS revenue, sum(cost) AS cost
      FROM ad_events GROUP BY advertiser)
SELECT advertiser, impressions, clicks, conversions, bounces, events,
       CASE WHEN impressions > 0 THEN {r('100e0 * clicks / impressions', 3)} ELSE 0 END AS ctr_pct,
       CASE WHEN clicks > 0 THEN {r('100e0 * conversions / clicks', 3)} ELSE 0 END AS cr_pct,
       CASE WHEN cost > 0 THEN {r('revenue / cost', 2)} ELSE 0 END AS roas,
       CASE WHEN conversions > 0 THEN {r('cost / conversions', 0)} END AS cac,
       {r('cost', 0)} AS cost, {r('revenue', 0)} AS revenue
FROM f ORDER BY roas DESC"""


def _fed(spark, rows, time, start, parts=3):
    """Feed a table to a stream in slices of time.

    After each slice the query runs to the end of its input and stops, so that
    its state passes from batch to batch and over restarts. Rows without a time
    are in the first slice.
    """
    source = fresh_path(spark, "source")
    seconds = F.col(time).cast("timestamp").cast("double")
    cuts = rows.select(seconds.alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.where(seconds >= low)
        if high is not None:
            early = seconds < high
            part = part.where(early | seconds.isNull() if low is None else early)
        part.write.mode("append").parquet(source)
        run.finish(start(topics.file_topic(spark, source, rows.schema)))


# Topic -------------------------------------------------------------------

def _messages(spark, sf_dir):
    """Ad events as topic messages with a JSON body and offsets."""
    events = topics.with_offsets(ad_events(spark, sf_dir))
    body = events.withColumns({
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "age_group": F.lit(None).cast("string"), "gender": F.lit(None).cast("string"),
        "session_id": F.lit(None).cast("string")})
    return topics.to_envelope(body, "advertiser", AD_EVENT.fieldNames(),
                              F.col("partition"), F.col("offset"), F.col("ts"))


_DECODED = f"""WITH {AD_EVENTS}
SELECT partition, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset",
       advertiser AS key, CAST(event_id AS VARCHAR) AS event_id, event_type, platform, campaign_id,
       {r('cost', 4)} AS cost, {r('revenue', 4)} AS revenue,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS event_timestamp
FROM ad_events"""
_DECODED_COLUMNS = ["partition", "offset", "key", "event_id", "event_type", "platform",
                    "campaign_id", "cost", "revenue", "event_timestamp"]


@query(_DECODED)
def event_decode(spark, sf_dir):
    """Envelope and JSON body back to typed columns."""
    return rounded(topics.decode(_messages(spark, sf_dir)).select(*_DECODED_COLUMNS), _CENTS)


@query(_DECODED)
def stream_ingest(spark, sf_dir):
    """The same through a stream of message files into a table."""
    sink = fresh_path(spark, "ingest")
    _fed(spark, stage(_messages(spark, sf_dir), "messages"), "timestamp",
         lambda stream: run.start_ingest(topics.decode(stream), sink))
    return rounded(run.ingested(spark, sink).select(*_DECODED_COLUMNS), _CENTS)


@query(f"""WITH {AD_EVENTS}
SELECT partition, count(*) AS messages, count(*) AS next_offset FROM ad_events GROUP BY partition""")
def topic_stats(spark, sf_dir):
    events = ad_events(spark, sf_dir).select("partition", "ts", "event_id")
    return topics.topic_totals(topics.with_offsets(events))


# Funnel ------------------------------------------------------------------

@query(f"WITH {AD_EVENTS} SELECT advertiser, {_COUNTERS} FROM ad_events GROUP BY advertiser")
def funnel_counters_by_advertiser(spark, sf_dir):
    return rounded(funnel_counters(ad_events(spark, sf_dir), "advertiser"), _CENTS)


QUERIES["funnel_counters"] = QUERIES.pop("funnel_counters_by_advertiser")
SQL["funnel_counters"] = SQL.pop("funnel_counters_by_advertiser")


@query(f"WITH {AD_EVENTS} SELECT advertiser, {_COUNTERS} FROM ad_events GROUP BY advertiser")
def funnel_merge(spark, sf_dir):
    """Counters per consumer partition, united and merged."""
    events = ad_events(spark, sf_dir)
    partials = funnel_counters(events, "partition", "advertiser").drop("partition")
    return rounded(merge_counters(partials, "advertiser"), _CENTS)


@query(_FUNNEL)
def funnel_metrics(spark, sf_dir):
    return funnel_report(ad_events(spark, sf_dir), "advertiser")


@query(_FUNNEL)
def stream_funnel(spark, sf_dir):
    """The running funnel of a stream over the events table."""
    path = fresh_path(spark, "funnel")
    _fed(spark, table(spark, sf_dir, "events"), "ts",
         lambda stream: run.start_running_funnel(as_ad_events(stream), path, "advertiser"))
    return run.running_funnel(spark, path)


# Windows and alerts ------------------------------------------------------

_WINDOWS = f"""WITH {AD_EVENTS},
pos AS (SELECT advertiser, event_type,
               row_number() OVER (PARTITION BY advertiser ORDER BY ts, event_id) AS p FROM ad_events),
win AS (SELECT advertiser, (p - 1) // {SIZE} + 1 AS "window", count(*) AS total,
               count(*) FILTER (event_type = 'click') AS clicks,
               count(*) FILTER (event_type = 'conversion') AS conversions,
               100e0 * count(*) FILTER (event_type = 'click') / count(*) AS ctr
        FROM pos GROUP BY 1, 2),
fired AS (
  SELECT advertiser, "window", 'LOW_CTR' AS type,
         printf('CTR = %.2f%% is below 15.0%%', ctr) AS message, 'WARNING' AS severity
  FROM win WHERE ctr < 15
  UNION ALL
  SELECT advertiser, "window", 'ZERO_CONVERSIONS',
         'no conversions in a window of ' || total || ' events', 'CRITICAL'
  FROM win WHERE conversions = 0 AND total > 5)"""


@query(f"""{_WINDOWS}
SELECT advertiser, "window", total, clicks, conversions, {r('ctr', 4)} AS ctr FROM win""")
def count_windows(spark, sf_dir):
    return rounded(windows_of(ad_events(spark, sf_dir), SIZE, ["advertiser"]), {"ctr": 4})


@query(f"""WITH {AD_EVENTS},
pos AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS p FROM ad_events)
SELECT (p - 1) // 100 + 1 AS "window", count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks,
       count(*) FILTER (event_type = 'conversion') AS conversions,
       {r("100e0 * count(*) FILTER (event_type = 'click') / count(*)", 4)} AS ctr
FROM pos GROUP BY 1""")
def count_windows_global(spark, sf_dir):
    """Windows of 100 events over the whole stream."""
    return rounded(windows_of(ad_events(spark, sf_dir), 100), {"ctr": 4})


@query(f"""{_WINDOWS}
SELECT advertiser, "window", total, clicks, conversions, {r('ctr', 4)} AS ctr FROM win""")
def stream_count_windows(spark, sf_dir):
    path = fresh_path(spark, "count-windows")
    _fed(spark, table(spark, sf_dir, "events"), "ts",
         lambda stream: run.start_count_windows(as_ad_events(stream), path, ["advertiser"], SIZE))
    return rounded(run.counted_windows(spark, path, ["advertiser"]), {"ctr": 4})


@query(f"{_WINDOWS} SELECT * FROM fired")
def alerts(spark, sf_dir):
    windows = windows_of(ad_events(spark, sf_dir), SIZE, ["advertiser"])
    return alert_rows(windows, **LIMITS)


@query(f'{_WINDOWS} SELECT * FROM fired ORDER BY "window" DESC, advertiser, type, severity LIMIT 5')
def alerts_last(spark, sf_dir):
    windows = windows_of(ad_events(spark, sf_dir), SIZE, ["advertiser"])
    return last_alerts(alert_rows(windows, **LIMITS))


# Sketches ----------------------------------------------------------------

_POINTS = {"q25": 0.25, "q50": 0.5, "q95": 0.95}


@query(f"""WITH {AD_EVENTS}
SELECT advertiser, count(cost) AS n, true AS within_bound FROM ad_events GROUP BY advertiser""")
def sketch_quantiles(spark, sf_dir):
    """Daily sketches of costs merged per advertiser: are the quantiles' exact ranks within the bound?"""
    rows = ad_events(spark, sf_dir).select("advertiser", F.to_date("ts").alias("day"), "cost")
    daily = stage(sketches.quantile_sketches(rows, ["advertiser", "day"], "cost"), "sketches")
    merged = sketches.merged_quantile_sketches(daily, ["advertiser"])
    quantiles = stage(sketches.sketch_quantiles(merged, _POINTS).select("advertiser", *_POINTS), "quantiles")
    checked = sketches.rank_errors(rows, quantiles, ["advertiser"], "cost", _POINTS)
    # A sketch's bound is 0.017 at k = 200; merging keeps it.
    return checked.select("advertiser", "n", (F.col("error") <= 0.03).alias("within_bound"))


@query(f"""WITH {AD_EVENTS}
SELECT a.advertiser, count(DISTINCT e.user_id) AS n_users, true AS within_bound
FROM ad_events a JOIN events e USING (event_id) GROUP BY a.advertiser""")
def sketch_distinct(spark, sf_dir):
    """Daily sketches of users merged per advertiser, against exact counts."""
    users = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = as_ad_events(table(spark, sf_dir, "events")).select("event_id", "advertiser", F.to_date("ts").alias("day"))
    rows = stage(rows.join(users, "event_id").select("advertiser", "day", "user_id"), "users")
    daily = stage(sketches.distinct_sketches(rows, ["advertiser", "day"], "user_id"), "sketches")
    merged = sketches.merged_distinct(daily, ["advertiser"])
    exact = rows.groupBy("advertiser").agg(F.count_distinct("user_id").alias("n_users"))
    off = F.abs(F.col("n_distinct") - F.col("n_users")) <= F.greatest(0.07 * F.col("n_users"), F.lit(1))
    return join_dimension(exact, merged, ["advertiser"]).select("advertiser", "n_users", off.alias("within_bound"))


@query("""
WITH users AS (SELECT DISTINCT event_type, user_id FROM events)
SELECT (SELECT count(*) FROM users WHERE event_type = 'click') AS n_one,
       (SELECT count(*) FROM users WHERE event_type = 'purchase') AS n_two,
       (SELECT count(*) FROM users a JOIN users b USING (user_id)
        WHERE a.event_type = 'click' AND b.event_type = 'purchase') AS n_both, true AS within_bound""")
def sketch_overlap(spark, sf_dir):
    """Users who clicked, who bought, and who did both: sketches against exact counts."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id")
    made = sketches.audience_sketches(rows, ["event_type"], "user_id")
    side = lambda name: F.max(F.when(F.col("event_type") == name, F.col("sketch")))
    both = made.agg(side("click").alias("one"), side("purchase").alias("two"))
    guess = both.select(*[c.alias(f"_{n}") for n, c in sketches.overlap(F.col("one"), F.col("two")).items()])
    per_user = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"),
                                           F.count_if(F.col("event_type") == "purchase").alias("b"))
    exact = per_user.agg(F.count_if(F.col("a") > 0).alias("n_one"),
                         F.count_if(F.col("b") > 0).alias("n_two"),
                         F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("n_both"))
    # One row each.
    joined = exact.withColumn("_row", F.lit(1)).join(guess.withColumn("_row", F.lit(1)), "_row")
    near = [F.abs(F.col(f"_{c}") - F.col(c)) <= 0.1 * F.greatest(F.col("n_one"), F.col("n_two"), F.lit(1))
            for c in ("n_one", "n_two", "n_both")]
    return joined.select("n_one", "n_two", "n_both", (near[0] & near[1] & near[2]).alias("within_bound"))


# Event time --------------------------------------------------------------

@query(f"""WITH {AD_EVENTS}
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '{_TIME}') AS window_start,
       strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, '{_TIME}') AS window_end, advertiser, {_COUNTERS}
FROM ad_events GROUP BY 1, 2, 3""")
def tumbling_funnel(spark, sf_dir):
    return rounded(_ends(time_windows(
        ad_events(spark, sf_dir), "1 hour", keys=("advertiser",))), _CENTS)


@query(f"""WITH {AD_EVENTS},
spread AS (SELECT e.*, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS s
           FROM ad_events e, range(4) t(k))
SELECT strftime(s, '{_TIME}') AS window_start, strftime(s + INTERVAL 1 HOUR, '{_TIME}') AS window_end, {_COUNTERS}
FROM spread GROUP BY 1, 2""")
def sliding_funnel(spark, sf_dir):
    return rounded(_ends(time_windows(ad_events(spark, sf_dir), "1 hour", "15 minutes")), _CENTS)


def _ends(windows):
    """Window ends as text, which all engines compare alike in any session zone."""
    return windows.withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


@query(f"""WITH {AD_EVENTS},
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, {_COUNTERS} FROM ad_events GROUP BY 1)
SELECT strftime(s, '{_TIME}') AS window_start, strftime(s + INTERVAL 1 HOUR, '{_TIME}') AS window_end,
       impressions, clicks, conversions, bounces, revenue, cost, events,
       s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ad_events) - INTERVAL 10 MINUTE AS closed
FROM w""")
def stream_tumbling_funnel(spark, sf_dir):
    """All hourly windows: those that the watermark has closed, and those in the state at the stream's end."""
    path = fresh_path(spark, "time-windows")
    _fed(spark, table(spark, sf_dir, "events"), "ts",
         lambda stream: run.start_time_windows(as_ad_events(stream), path, "1 hour"))
    return rounded(_ends(run.all_time_windows(spark, path)), _CENTS)


@query(f"""{_WINDOWS}
SELECT *, row_number() OVER (PARTITION BY advertiser ORDER BY "window", type) AS number FROM fired""")
def stream_alerts(spark, sf_dir):
    """Alerts that a stream fires as windows fill, and those of the windows open at its end."""
    path = fresh_path(spark, "alerts")
    _fed(spark, table(spark, sf_dir, "events"), "ts",
         lambda stream: start_alerts(as_ad_events(stream), path, ["advertiser"], SIZE, **LIMITS))
    fired = fired_alerts(spark, path)
    last = open_alerts(spark, path, ["advertiser"], **LIMITS)
    # At most two alerts a key are open.
    counts = fired.groupBy("advertiser").agg(F.max("number").alias("_before"))
    place = F.row_number().over(Window.partitionBy("advertiser").orderBy("type"))
    numbered = join_dimension(last, counts, ["advertiser"], "left").withColumn(
        "number", place + F.coalesce("_before", F.lit(0))).drop("_before")
    return fired.unionByName(numbered)


@query("""SELECT count(*) AS input_rows, count(*) AS observed_rows,
       count(*) FILTER (event_type = 'click') AS observed_clicks FROM events""")
def stream_progress(spark, sf_dir):
    """Rows and observed numbers of all batches, as a listener wrote them down."""
    path = fresh_path(spark, "observed")
    log = run.ProgressLog(spark, fresh_path(spark, "progress"))
    spark.streams.addListener(log)
    try:
        def start(stream):
            seen = stream.observe("seen", F.count("*").alias("rows"), F.count_if(F.col("event_type") == "click").alias("clicks"))
            query = run.start_ingest(seen, path)
            query.awaitTermination()
            log.wait(query)
            return query

        _fed(spark, table(spark, sf_dir, "events"), "ts", start)
    finally:
        spark.streams.removeListener(log)
    number = lambda c: F.coalesce(F.sum(F.col("observed")[c].cast("bigint")), F.lit(0))
    return log.rows().agg(F.sum("input_rows").alias("input_rows"), number("rows").alias("observed_rows"),
                          number("clicks").alias("observed_clicks"))
