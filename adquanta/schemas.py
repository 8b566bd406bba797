"""Fixed schemas of the inputs and of the records exchanged between operators."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Names of money columns in source records, which carry a currency suffix.
WIRE_NAMES = {"spent": "spent_kzt", "cpc": "cpc_kzt", "cac": "cac_kzt", "revenue": "revenue_kzt",
              "budget": "budget_kzt", "cost": "cost_kzt"}

# Column order and types of the campaign file.
CAMPAIGN = StructType([
    StructField("ad_id", StringType()),
    StructField("advertiser", StringType()),
    StructField("country", StringType()),
    StructField("start_date", StringType()),
    StructField("status", StringType()),
    StructField("collected_at", StringType()),
    StructField("source", StringType()),
    StructField("platform", StringType()),
    StructField("target_age", StringType()),
    StructField("target_gender", StringType()),
    StructField("duration_days", IntegerType()),
    StructField("impressions", LongType()),
    StructField("clicks", LongType()),
    StructField("ctr_pct", DoubleType()),
    StructField("conversions", IntegerType()),
    StructField("cr_pct", DoubleType()),
    StructField("spent", DoubleType()),
    StructField("cpc", DoubleType()),
    StructField("cac", DoubleType()),
    StructField("revenue", DoubleType()),
    StructField("roas", DoubleType()),
    StructField("budget", DoubleType()),
])

# Column order and types of the benchmark event file.
BENCHMARK_EVENT = StructType([
    StructField("event_id", LongType()),
    StructField("advertiser", StringType()),
    StructField("platform", StringType()),
    StructField("age_group", StringType()),
    StructField("gender", StringType()),
    StructField("event_type", StringType()),
    StructField("impressions", LongType()),
    StructField("clicks", LongType()),
    StructField("conversions", LongType()),
    StructField("spent", DoubleType()),
    StructField("revenue", DoubleType()),
    StructField("ctr_pct", DoubleType()),
    StructField("cr_pct", DoubleType()),
    StructField("cac", DoubleType()),
    StructField("roas", DoubleType()),
    StructField("duration_d", IntegerType()),
    StructField("budget", DoubleType()),
    StructField("campaign_id", StringType()),
])

# Fields of one ad event in the JSON body of a topic message.
AD_EVENT = StructType([
    StructField("event_id", StringType()),
    StructField("event_type", StringType()),
    StructField("advertiser", StringType()),
    StructField("platform", StringType()),
    StructField("age_group", StringType()),
    StructField("gender", StringType()),
    StructField("revenue", DoubleType()),
    StructField("cost", DoubleType()),
    StructField("campaign_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("session_id", StringType()),
])

# The supplied events table.
EVENTS_TABLE = StructType([
    StructField("event_id", LongType()),
    StructField("ts", TimestampNTZType()),
    StructField("user_id", LongType()),
    StructField("event_type", StringType()),
    StructField("value", DoubleType()),
    StructField("props", StringType()),
])


def on_the_wire(schema: StructType) -> StructType:
    """The schema with the names that source records use."""
    return StructType([StructField(WIRE_NAMES.get(f.name, f.name), f.dataType) for f in schema.fields])
