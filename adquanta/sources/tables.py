"""Campaign and ad-event views over the supplied star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names used by the ad-event view.
EVENT_TYPES = {"view": "impression", "click": "click", "purchase": "conversion",
               "error": "bounce", "signup": "signup"}
# The line return flags and the platform lists they form.
FLAGS = ("A", "N", "R")
PLATFORMS = ("A", "A,N", "A,N,R", "A,R", "N", "N,R", "R")
# Tables that a campaign row is made from.
CAMPAIGN_TABLES = ("orders", "lineitem", "customer", "nation", "region")
N_PARTITIONS = 3
N_ADVERTISERS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount) -> F.Column:
    """Money as whole cents, so that sums do not depend on their order.

    Amounts are not negative, so adding a half and cutting rounds half up; it
    costs much less than ``round``, which goes through big decimals.
    """
    return F.floor(amount * 100 + 0.5)


def order_rollup(lineitem: DataFrame) -> DataFrame:
    """Line items of an order combined; partial sums leave each scan task."""
    has = [F.max((F.col("l_returnflag") == flag).cast("int")).alias(f"_{flag}")
           for flag in FLAGS]
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity").cast("bigint")
    sums = lineitem.groupBy("l_orderkey").agg(
        *has,
        F.sum(quantity).alias("clicks"),
        F.sum(quantity * (20 + F.col("l_linenumber"))).alias("impressions"),
        F.count("*").cast("int").alias("conversions"),
        F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("duration_days"),
        F.sum(cents(price)).alias("_gross"),
        F.sum(cents(price * (1 + F.col("l_tax")))).alias("_budget"),
    )
    names = [F.when(F.col(f"_{flag}") == 1, F.lit(flag)) for flag in FLAGS]
    return sums.select(
        "l_orderkey", F.concat_ws(",", *names).alias("platform"),
        "clicks", "impressions", "conversions", "duration_days",
        (F.col("_gross") / 1000).alias("spent"), (F.col("_budget") / 1000).alias("budget"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign row per order.

    Orders and line items meet on the order key, which the roll-up is already
    partitioned by; both grow with the data, so they are merge-joined at every
    scale. Nation and region have 25 and 5 rows at every scale, so they are
    broadcast; for customers Spark decides by size, and adaptive execution
    splits a customer key that holds many orders.
    """
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rollup = order_rollup(table(spark, sf_dir, "lineitem"))
    joined = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(rollup.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    revenue, spent = F.col("o_totalprice"), F.col("spent")
    return joined.select(
        F.col("o_orderkey").alias("ad_id"),
        F.col("n_name").alias("advertiser"),
        F.col("r_name").alias("country"),
        F.col("o_orderdate").alias("start_date"),
        "platform",
        F.col("c_mktsegment").alias("target_age"),
        F.col("o_orderstatus").alias("target_gender"),
        "duration_days", "impressions", "clicks",
        F.try_divide(100 * F.col("clicks"), F.col("impressions")).alias("ctr_pct"),
        "conversions",
        F.try_divide(100 * F.col("conversions"), F.col("clicks")).alias("cr_pct"),
        "spent",
        F.try_divide(spent, F.col("clicks")).alias("cpc"),
        F.try_divide(spent, F.col("conversions")).alias("cac"),
        revenue.alias("revenue"),
        F.try_divide(revenue, spent).alias("roas"),
        "budget",
    )


def as_ad_events(events: DataFrame) -> DataFrame:
    """The events table, batch or stream, as ad events."""
    kind = F.col("event_type")
    for name, ad_name in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == name, ad_name).otherwise(kind)
    shard = F.pmod(F.col("user_id"), F.lit(N_PARTITIONS))
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("adv_"), F.pmod(F.col("user_id"), F.lit(N_ADVERTISERS))).alias("advertiser"),
        F.concat(F.lit("P"), shard).alias("platform"),
        kind.alias("event_type"),
        F.col("value").alias("cost"),
        F.when(F.col("event_type") == "purchase", 20 * F.col("value"))
        .otherwise(F.lit(0.0)).alias("revenue"),
        F.concat(F.lit("camp_"), F.get_json_object("props", "$.k")).alias("campaign_id"),
        shard.cast("int").alias("partition"),
    )


def ad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ad_events(table(spark, sf_dir, "events"))
