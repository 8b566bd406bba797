"""Funnels, windows, alerts; streams against their batch form."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adquanta.schemas import AD_EVENT, EVENTS_TABLE
from adquanta.session import fresh_path
from adquanta.sources import topics
from adquanta.sources.tables import ad_events, as_ad_events
from adquanta.streaming import run
from adquanta.streaming.alerts import closed_windows, fired_alerts, open_alerts, start_alerts
from adquanta.streaming.batches import BatchTable
from adquanta.streaming.funnel import (
    funnel_counters,
    funnel_report,
    merge_counters,
    time_windows,
    with_ratios,
)
from adquanta.streaming.windows import alerts, count_windows, last_alerts

START = datetime(2024, 1, 1)
KINDS = ["impression", "click", "conversion", "bounce", "other"]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    """600 events; one advertiser has two thirds of them."""
    rng = random.Random(2)
    rows = [(i, START + timedelta(minutes=7 * (i // 2)), "hot" if i % 3 else f"a{i % 4}",
             rng.choice(KINDS), float(rng.randint(1, 9)), float(rng.randint(10, 99)))
            for i in range(600)]
    return spark.createDataFrame(
        rows, "event_id long, ts timestamp, advertiser string, event_type string, cost double, "
              "revenue double").repartition(5)


@pytest.fixture()
def files(spark, events):
    """The events as five files in order of time."""
    path = fresh_path(spark, "events")
    for part in range(5):
        events.where(F.floor(F.col("event_id") / 120) == part).coalesce(1).write.mode("append").parquet(path)
    return path


def in_order(spark, path, schema, fmt="parquet"):
    return topics.file_topic(spark, path, schema, files_per_trigger=1, fmt=fmt)


def test_funnel_counts_cost_of_every_event(spark):
    df = spark.createDataFrame(
        [("a", "impression", 1.0, 5.0), ("a", "conversion", 2.0, 7.0), ("a", "unknown", 4.0, 9.0)],
        "advertiser string, event_type string, cost double, revenue double")
    r = funnel_counters(df, "advertiser").first()
    assert (r.impressions, r.clicks, r.conversions, r.bounces, r.events) == (1, 0, 1, 0, 3)
    assert (r.cost, r.revenue) == (7.0, 7.0)


def test_ratios_and_their_guards(spark):
    df = spark.createDataFrame(
        [("x", 300, 10, 3, 0, 50.0, 20.0, 313), ("y", 0, 0, 0, 4, 0.0, 0.0, 4)],
        "advertiser string, impressions long, clicks long, conversions long, bounces long, "
        "revenue double, cost double, events long")
    got = {r.advertiser: r for r in with_ratios(df).collect()}
    assert (got["x"].ctr_pct, got["x"].cr_pct, got["x"].roas, got["x"].cac) == (3.333, 30.0, 2.5, 7.0)
    assert (got["y"].ctr_pct, got["y"].cr_pct, got["y"].roas, got["y"].cac) == (0, 0, 0, None)
    assert with_ratios(df, cac_when_empty=0).where("advertiser = 'y'").first().cac == 0.0


def test_merge_equals_direct(spark, events):
    direct = funnel_counters(events, "advertiser")
    parts = funnel_counters(events.withColumn("p", F.col("event_id") % 4), "p", "advertiser")
    merged = merge_counters(parts, "advertiser")
    assert rows_of(direct, *merged.columns) == rows_of(merged, *merged.columns)


def brute_windows(events, size, keyed):
    groups = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        groups.setdefault(r.advertiser if keyed else None, []).append(r.event_type)
    out = []
    for k, kinds in groups.items():
        for i in range(0, len(kinds), size):
            w = kinds[i:i + size]
            out.append((k, i // size + 1, len(w), w.count("click"), w.count("conversion")))
    return out


def test_count_windows_with_a_hot_key(events):
    got = rows_of(count_windows(events, 10, ["advertiser"]), "advertiser", "window", "total",
                  "clicks", "conversions")
    assert got == sorted(brute_windows(events, 10, True), key=str)


def test_global_count_windows(events):
    got = rows_of(count_windows(events, 70), "window", "total", "clicks", "conversions")
    assert got == sorted([w[1:] for w in brute_windows(events, 70, False)], key=str)


def test_alert_rules(spark):
    df = spark.createDataFrame(
        [(1, 100, 0, 0, 0.0), (2, 100, 1, 1, 1.0), (3, 31, 1, 0, 3.2), (4, 30, 1, 0, 3.3)],
        "window long, total long, clicks long, conversions long, ctr double")
    got = rows_of(alerts(df), "window", "type", "severity", "message")
    assert got == [
        (1, "LOW_CTR", "WARNING", "CTR = 0.00% is below 0.5%"),
        (1, "ZERO_CONVERSIONS", "CRITICAL", "no conversions in a window of 100 events"),
        (3, "ZERO_CONVERSIONS", "CRITICAL", "no conversions in a window of 31 events"),
    ]
    assert [r.window for r in last_alerts(alerts(df), 2).collect()] == [3, 1]


def test_running_funnel_stream_equals_batch(spark, events, files):
    path = fresh_path(spark, "funnel")
    query = run.finish(run.start_running_funnel(in_order(spark, files, events.schema), path, "advertiser"))
    got, want = run.running_funnel(spark, path), funnel_report(events, "advertiser")
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    progress = run.progress(query)
    assert progress.agg(F.sum("input_rows")).first()[0] == 600
    assert progress.where("processed_rate > 0").count() == 5


def test_stream_resumes_from_its_checkpoint(spark, events):
    source, path = fresh_path(spark, "events"), fresh_path(spark, "funnel")
    first = events.where("event_id < 250")
    first.write.parquet(source)
    run.finish(run.start_running_funnel(in_order(spark, source, events.schema), path, "advertiser"))
    want = funnel_report(first, "advertiser")
    assert rows_of(run.running_funnel(spark, path), *want.columns) == rows_of(want, *want.columns)
    events.where("event_id >= 250").write.mode("append").parquet(source)
    run.finish(run.start_running_funnel(in_order(spark, source, events.schema), path, "advertiser"))
    want = funnel_report(events, "advertiser")
    assert rows_of(run.running_funnel(spark, path), *want.columns) == rows_of(want, *want.columns)


def test_count_window_stream_equals_batch(spark, events, files):
    path = fresh_path(spark, "windows")
    stream = in_order(spark, files, events.schema)
    run.finish(run.start_count_windows(stream, path, ["advertiser"], 10))
    columns = ("advertiser", "window", "total", "clicks", "conversions", "ctr")
    got = run.counted_windows(spark, path, ["advertiser"])
    assert rows_of(got, *columns) == rows_of(count_windows(events, 10, ["advertiser"]), *columns)


def test_count_window_batch_may_be_repeated(spark, events, files):
    """A batch that runs again after its output was written leaves the same windows."""
    path = fresh_path(spark, "windows")
    columns = ("advertiser", "window", "total", "clicks", "conversions")
    run.finish(run.start_count_windows(
        in_order(spark, files, events.schema), path, ["advertiser"], 10))
    before = rows_of(run.counted_windows(spark, path, ["advertiser"]), *columns)
    # Without its commit mark Spark takes the last batch for unfinished.
    commits = Path(f"{path}/checkpoint/commits")
    last = max((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    query = run.finish(run.start_count_windows(
        in_order(spark, files, events.schema), path, ["advertiser"], 10))
    assert [p["batchId"] for p in query.recentProgress][0] == int(last.name)
    assert rows_of(run.counted_windows(spark, path, ["advertiser"]), *columns) == before


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_time_window_stream_equals_batch(spark, events, files, slide):
    path = fresh_path(spark, "time")
    stream = in_order(spark, files, events.schema)
    run.finish(run.start_time_windows(stream, path, "1 hour", slide, ("advertiser",), "10 minutes"))
    closed = events.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    batch = time_windows(events, "1 hour", slide, ("advertiser",)).where(F.col("window_end") <= F.lit(closed))
    got = run.ingested(spark, path)
    assert got.count() > 100
    assert rows_of(got, *batch.columns) == rows_of(batch, *batch.columns)


def test_rows_behind_the_watermark_are_dropped(spark, events):
    source, path = fresh_path(spark, "late"), fresh_path(spark, "time")
    one = events.limit(1)
    at = lambda i, t: one.withColumn("event_id", F.lit(i).cast("long")).withColumn(
        "ts", F.lit(START + timedelta(hours=t)).cast("timestamp"))
    for i, hour in enumerate([1, 9, 2, 20]):  # the third is late
        at(i, hour).coalesce(1).write.mode("append").parquet(source)
        run.finish(run.start_time_windows(in_order(spark, source, events.schema), path, "1 hour"))
    starts = [r[0].hour for r in run.ingested(spark, path).orderBy("window_start").select("window_start").collect()]
    assert starts == [1, 9]


# Topics ------------------------------------------------------------------

def test_envelope_round_trip(spark, events):
    body = events.withColumns({
        "timestamp": F.col("ts").cast("string"), "platform": F.lit("P1"),
        **{c: F.lit(None).cast("string") for c in ("age_group", "gender", "campaign_id", "session_id")}})
    messages = topics.to_envelope(body, "advertiser", AD_EVENT.fieldNames(), F.lit(0), F.col("event_id"),
                                  F.col("ts"))
    got = topics.decode(messages)
    assert rows_of(got, "event_id", "advertiser", "event_type", "cost", "revenue") == rows_of(
        events.withColumn("event_id", F.col("event_id").cast("string")),
        "event_id", "advertiser", "event_type", "cost", "revenue")
    assert got.where("key = advertiser").count() == 600


def test_bad_json_gives_null_fields(spark):
    df = spark.createDataFrame([(b"k", b"not json", 0, 1, START)],
                               "key binary, value binary, partition int, offset long, timestamp timestamp")
    r = topics.decode(df).first()
    assert r.key == "k" and r.offset == 1 and r.event_type is None


def test_offsets_and_totals(spark, events):
    df = topics.with_offsets(events.withColumn("partition", (F.col("event_id") % 2).cast("int")))
    got = {r.partition: (r.messages, r.next_offset) for r in topics.topic_totals(df).collect()}
    assert got == {0: (300, 300), 1: (300, 300)}
    assert df.where("offset = 0").count() == 2


def test_stream_of_a_single_file(spark, sf_dir):
    stream = as_ad_events(topics.file_topic(spark, f"{sf_dir}/events.parquet", EVENTS_TABLE))
    path = fresh_path(spark, "ingest")
    run.finish(run.start_ingest(stream, path))
    want = ad_events(spark, sf_dir)
    assert rows_of(run.ingested(spark, path), *want.columns) == rows_of(want, *want.columns)


def test_json_file_topic(spark, events):
    source, path = fresh_path(spark, "json"), fresh_path(spark, "ingest")
    events.write.json(source)
    run.finish(run.start_ingest(topics.file_topic(spark, source, events.schema, fmt="json"), path))
    assert rows_of(run.ingested(spark, path), *events.columns) == rows_of(events, *events.columns)


def test_count_windows_of_a_null_key_go_on_over_batches(spark, events):
    """Three batches; windows of the missing advertiser continue where the last batch ended."""
    rows = events.withColumn("advertiser", F.when(F.col("advertiser") != "hot", F.col("advertiser")))
    path, source = fresh_path(spark, "null-windows"), fresh_path(spark, "null-events")
    for part in range(3):
        rows.where(F.floor(F.col("event_id") / 200) == part).write.mode("append").parquet(source)
        stream = topics.file_topic(spark, source, rows.schema)
        run.finish(run.start_count_windows(stream, path, ["advertiser"], 7))
    columns = ("advertiser", "window", "total", "clicks", "conversions")
    assert rows_of(run.counted_windows(spark, path, ["advertiser"]), *columns) == rows_of(
        count_windows(rows, 7, ["advertiser"]), *columns)


def test_old_versions_are_pruned(spark, files, events):
    path = fresh_path(spark, "pruned")
    run.finish(run.start_running_funnel(in_order(spark, files, events.schema), path, "advertiser"))
    kept = {r[0] for r in spark.read.parquet(f"{path}/versions").select("batch").distinct().collect()}
    assert len(kept) == 2
    assert rows_of(run.running_funnel(spark, path), "advertiser", "events", "roas") == rows_of(
        funnel_report(events, "advertiser"), "advertiser", "events", "roas")


@pytest.mark.parametrize("timed", [True, False])
def test_slices_hold_every_row(spark, events, timed):
    """Rows without a time too, be they some or all."""
    from adquanta.plans.events import _fed

    missing = (F.col("event_id") % 7 == 0) if timed else F.lit(True)
    rows = events.withColumn("ts", F.when(~missing, F.col("ts")))
    sink = fresh_path(spark, "slices")
    _fed(spark, rows, "ts", lambda stream: run.start_ingest(stream, sink))
    assert rows_of(run.ingested(spark, sink), *rows.columns) == rows_of(rows, *rows.columns)


# Alerts out of a stream ----------------------------------------------------

RULES = {"low_ctr": 20.0, "min_total": 3}


def all_alerts(spark, path):
    """(advertiser, window, type, message, severity) of fired and open alerts."""
    columns = ("advertiser", "window", "type", "message", "severity")
    return rows_of(fired_alerts(spark, path).select(*columns).union(
        open_alerts(spark, path, ["advertiser"], **RULES).select(*columns)), *columns)


def repeat_last_batch(path):
    """Take the commit mark away: Spark takes the last batch for unfinished."""
    commits = Path(f"{path}/checkpoint/commits")
    last = max((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    return int(last.name)


def test_alert_stream_equals_batch_and_numbers_each_once(spark, events, files):
    path = fresh_path(spark, "alerts")

    def go():
        return run.finish(start_alerts(in_order(spark, files, events.schema), path, ["advertiser"], 10, **RULES))

    go()
    want = rows_of(alerts(count_windows(events, 10, ["advertiser"]), **RULES),
                   "advertiser", "window", "type", "message", "severity")
    assert len(want) > 20 and all_alerts(spark, path) == want
    numbered = fired_alerts(spark, path).select("advertiser", "window", "type", "number").collect()
    by_key = {}
    for r in sorted(numbered, key=lambda r: (r.advertiser, r.window, r.type)):
        by_key.setdefault(r.advertiser, []).append(r.number)
    assert all(n == list(range(1, len(n) + 1)) for n in by_key.values())
    # A batch that runs again after its output was written fires nothing twice.
    last = repeat_last_batch(path)
    assert go().recentProgress[0]["batchId"] == last
    assert all_alerts(spark, path) == want
    assert rows_of(fired_alerts(spark, path), "advertiser", "window", "type", "number") == sorted(
        map(tuple, numbered), key=str)


def test_quiet_keys_are_judged_without_an_event(spark):
    """Key q stops after 4 of 10 events; k goes on. q returns much later in a window of its own."""
    path, source = fresh_path(spark, "idle"), fresh_path(spark, "idle-events")
    schema = "event_id long, ts timestamp, advertiser string, event_type string"
    at = lambda minute: START + timedelta(minutes=minute)
    batches = [
        [(i, at(i), "q", "impression") for i in range(4)] + [(100 + i, at(i), "k", "click") for i in range(6)],
        [(200 + i, at(120 + i), "k", "conversion") for i in range(4)],
        [(300 + i, at(130 + i), "q", "click") for i in range(2)] + [(400, at(131), None, "click")],
        [(500, at(900), "k", "click")],
    ]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = topics.file_topic(spark, source, spark.createDataFrame([], schema).schema)
        run.finish(start_alerts(stream, path, ["advertiser"], 10, **RULES, idle="30 minutes"))
        seen.append(rows_of(closed_windows(spark, path), "advertiser", "window", "total", "clicks", "conversions"))
    # In the first batch nothing is full and nobody has been quiet for long.
    assert seen[0] == []
    # k's ninth to tenth events fill its window; q is judged with four events.
    assert seen[1] == [("k", 1, 10, 6, 4), ("q", 1, 4, 0, 0)]
    assert seen[2] == seen[1]
    # The later clock closes q's second window, numbered after the first, and that of the null key.
    assert seen[3] == [("k", 1, 10, 6, 4), ("q", 1, 4, 0, 0), ("q", 2, 2, 2, 0), (None, 1, 1, 1, 0)]
    assert rows_of(fired_alerts(spark, path), "advertiser", "window", "type", "number") == [
        ("q", 1, "LOW_CTR", 1), ("q", 1, "ZERO_CONVERSIONS", 2)]


def test_batch_tables_merge_old_batches(spark):
    """Folders stay few, rows stay whole, and a repeated batch replaces its own."""
    table = BatchTable(fresh_path(spark, "parts"), every=3)
    for n in range(20):
        for _ in range(2):
            table.write(spark.range(n * 10, n * 10 + 4).coalesce(1), n)
        assert sorted(r.id for r in table.read(spark).collect()) == [10 * i + j for i in range(n + 1) for j in range(4)]
    names = [f.name for f in Path(table.path).iterdir() if f.is_dir()]
    assert len(names) <= 3 + 3 + 4 and any(x.startswith("upto=") for x in names)
    # A merged part that was not completed does not count.
    newest = max((x for x in names if x.startswith("upto=")), key=lambda x: int(x[5:]))
    whole = [r.id for r in table.read(spark).collect()]
    Path(f"{table.path}/upto=19").mkdir()
    assert sorted(r.id for r in table.read(spark).collect()) == sorted(whole) and newest != "upto=19"


@pytest.mark.parametrize("keys", [(), ("advertiser",)])
def test_windows_open_at_the_end_are_in_the_state(spark, events, files, keys):
    path = fresh_path(spark, "held")
    run.finish(run.start_time_windows(in_order(spark, files, events.schema), path, "1 hour", None, keys, "3 hours"))
    closed = events.agg(F.max("ts")).first()[0] - timedelta(hours=3)
    want = time_windows(events, "1 hour", None, keys).withColumn("closed", F.col("window_end") <= F.lit(closed))
    got = run.all_time_windows(spark, path, keys)
    assert got.where("not closed").count() > 2
    columns = ("window_start", "window_end", *keys, "impressions", "clicks", "conversions", "bounces", "revenue",
               "cost", "events", "closed")
    assert rows_of(got, *columns) == rows_of(want, *columns)


def test_progress_log_keeps_every_batch(spark, events, files):
    """Two runs of a stream: all batches, with what the stream observed in each."""
    log = run.ProgressLog(spark, fresh_path(spark, "log"))
    path = fresh_path(spark, "logged")
    spark.streams.addListener(log)
    try:
        stream = in_order(spark, files, events.schema).observe("seen", F.count("*").alias("rows"), F.max("cost").alias("top"))
        query = run.finish(run.start_ingest(stream, path))
        log.wait(query)
    finally:
        spark.streams.removeListener(log)
    rows = log.rows().collect()
    assert len(rows) >= 5 and sum(r.input_rows for r in rows) == 600
    assert sum(int(r.observed["rows"]) for r in rows if "rows" in r.observed) == 600
    assert max(float(r.observed["top"]) for r in rows if r.observed.get("top") not in (None, "None")) == 9.0
    with pytest.raises(TimeoutError):
        log.ended.clear()
        log.wait(query, 0.1)
