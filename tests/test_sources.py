import json

import pytest
from pyspark.sql import functions as F

from adquanta.schemas import BENCHMARK_EVENT, CAMPAIGN
from adquanta.session import fresh_path, shared_folder, stage
from adquanta.sources import files, topics

HEADER = ",".join(f.name for f in CAMPAIGN.fields)
LINE = ('1,Kaspi,KZ,2026-04-01,ACTIVE,2026-04-20,ads,"Facebook, Instagram",25-34,all,10,'
        "1000,50,5.0,2,4.0,100.5,2.01,50.25,600.0,5.97,200.0")


@pytest.mark.parametrize("mark", ["", "﻿"])
def test_campaign_csv(spark, tmp_path, mark):
    path = tmp_path / "ads.csv"
    path.write_text(f"{mark}{HEADER}\n{LINE}\n", encoding="utf-8")
    df = files.read_campaigns(spark, str(path))
    assert df.schema == CAMPAIGN
    r = df.first()
    assert (r.ad_id, r.advertiser, r.platform) == ("1", "Kaspi", "Facebook, Instagram")
    assert (r.duration_days, r.impressions, r.spent, r.budget) == (10, 1000, 100.5, 200.0)


def test_benchmark_csv_and_partitions(spark, tmp_path):
    header = ",".join(f.name for f in BENCHMARK_EVENT.fields)
    path = tmp_path / "events.csv"
    path.write_text(f"{header}\n7,a,F,25-34,f,click,10,2,1,5.5,9.5,20.0,50.0,5.5,1.7,3,8.0,c1\n")
    df = files.read_benchmark_events(spark, str(path), 3)
    assert df.rdd.getNumPartitions() == 3 and df.first().campaign_id == "c1"
    assert files.read_benchmark_events(spark, str(path)).first().event_id == 7


def test_written_csv_reads_back(spark, tmp_path):
    path = tmp_path / "ads.csv"
    path.write_text(f"{HEADER}\n{LINE}\n")
    df = files.read_campaigns(spark, str(path))
    out = str(tmp_path / "out")
    files.write_csv(df, out)
    assert files.read_campaigns(spark, out).collect() == df.collect()
    files.write_parquet(df, out, mode="overwrite")
    assert spark.read.parquet(out).collect() == df.collect()


def test_scored_file_has_the_fixed_columns(spark, tmp_path):
    df = spark.range(2).select(*[F.lit("x").alias(c) for c in reversed(files.SCORED_COLUMNS)])
    files.write_scored(df, str(tmp_path / "scored"))
    assert tuple(spark.read.csv(str(tmp_path / "scored"), header=True).columns) == files.SCORED_COLUMNS


def test_json_keeps_nulls_and_nesting(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1.0, 2.0])], "a int, b string, c array<double>")
    files.write_json(df.select(F.struct("a", "b", "c").alias("doc")), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"doc": {"a": 1, "b": None, "c": [1.0, 2.0]}}


def test_reuse_releases(spark):
    df = spark.range(5)
    with files.reuse(df) as kept:
        assert kept.count() == 5 and kept.is_cached
    assert not df.is_cached


def test_view(spark):
    files.register_view(spark.range(3), "numbers")
    assert spark.sql("select sum(id) from numbers").first()[0] == 3


def test_staged_data_lies_in_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(folder + "/x-")
    df = spark.range(4).withColumn("v", F.col("id") * 2)
    back = stage(df, "t")
    assert sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(4)]
    assert all("/t-" in f for f in back.inputFiles())


def test_source_names_of_money_are_read(spark):
    body = ('{"event_id": "e", "event_type": "conversion", "revenue_kzt": 5000.5, "cost_kzt": 300.25}',
            '{"event_id": "f", "event_type": "click", "revenue": 1.5, "cost": 2.5}')
    rows = [(0, i, None, bytearray(b"k"), bytearray(b.encode())) for i, b in enumerate(body)]
    messages = spark.createDataFrame(
        rows, "partition int, offset long, timestamp timestamp, key binary, value binary")
    got = [(r.revenue, r.cost) for r in topics.decode(messages).orderBy("offset").collect()]
    assert got == [(5000.5, 300.25), (1.5, 2.5)]


@pytest.mark.parametrize("name", ["plain", "dash-", "hat^", "sp ace"])
def test_file_topic_takes_folders(spark, tmp_path, name):
    spark.range(3).write.parquet(str(tmp_path / name))
    for path in (f"{tmp_path}/{name}", f"{tmp_path}/{name}/"):
        stream = topics.file_topic(spark, path, spark.range(1).schema)
        query = stream.writeStream.format("memory").queryName("taken").outputMode("append") \
            .trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("taken").count() == 3


@pytest.mark.parametrize("name", ["odd[1]", "star*", "end]", "a?b", "x{1}", "back\\slash"])
def test_file_topic_refuses_pattern_characters(spark, tmp_path, name):
    """Spark would read each file there several times."""
    with pytest.raises(ValueError, match="pattern characters"):
        topics.file_topic(spark, f"{tmp_path}/{name}", spark.range(1).schema)
