"""Ad-event topics: message envelope, Kafka source and file stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adquanta.operators.positions import with_position
from adquanta.schemas import AD_EVENT, WIRE_NAMES


def kafka_topic(spark: SparkSession, servers: str, topic: str,
                starting: str = "earliest", **options: str) -> DataFrame:
    """Stream of a Kafka topic (needs the Kafka connector on the class path).

    Keys decide the topic partition, so events of one advertiser stay in
    order within a partition; each partition is read by one task.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    return reader.options(**options).load()


def file_topic(spark: SparkSession, path: str, schema: StructType,
               files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Stream of the files at a path, either one file or a folder of files.

    Spark's file stream takes a path for a pattern, and under a folder whose own
    name holds pattern characters it lists every file several times, however
    they are escaped. Such paths raise an error in place of repeated rows.
    """
    path = path.rstrip("/")
    if any(c in "*?[]{}\\" for c in path):
        raise ValueError(f"a stream of files cannot be read from a path with pattern characters: {path!r}")
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern that matches the path itself also accepts a single file.
    last = f"\\{path[-1]}" if path[-1] in "^-" else path[-1]
    return reader.load(f"{path[:-1]}[{last}]")


def to_envelope(events: DataFrame, key: str, fields: list[str], partition: Column,
                offset: Column, timestamp: Column) -> DataFrame:
    """Messages with the columns of a Kafka source: key, JSON value and position.

    The JSON fields have the names of source records.
    """
    return events.select(
        F.col(key).cast("binary").alias("key"),
        F.to_json(F.struct(*[F.col(f).alias(WIRE_NAMES.get(f, f)) for f in fields])).cast("binary").alias("value"),
        partition.cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        timestamp.alias("timestamp"),
    )


def decode(messages: DataFrame, schema: StructType = AD_EVENT) -> DataFrame:
    """Typed event columns next to the position and time of the message.

    Money fields are read under the names that source records use and under
    their own. Event fields that share a name with the envelope get the prefix
    ``event_``.
    """
    wire = {f.name: WIRE_NAMES[f.name] for f in schema.fields if f.name in WIRE_NAMES}
    both = StructType(list(schema.fields))
    for f in schema.fields:
        if f.name in wire:
            both = both.add(wire[f.name], f.dataType)
    body = F.from_json(F.col("value").cast("string"), both)
    envelope = ("partition", "offset", "timestamp", "key")
    parsed = messages.select(
        "partition", "offset", "timestamp", F.col("key").cast("string").alias("key"),
        body.alias("_body"))
    def field(name: str) -> Column:
        own = F.col("_body")[name]
        return F.coalesce(F.col("_body")[wire[name]], own) if name in wire else own

    return parsed.select(*envelope, *[
        field(f.name).alias(f"event_{f.name}" if f.name in envelope else f.name)
        for f in schema.fields
    ])


def with_offsets(events: DataFrame, partition: str = "partition",
                 order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Offsets from 0 in event order within each topic partition.

    A topic has few partitions, so each may hold a large share of the rows;
    positions are therefore taken from range slices.
    """
    numbered = with_position(events, list(order), [partition], "_position")
    return numbered.withColumn("offset", F.col("_position") - 1).drop("_position")


def topic_totals(messages: DataFrame) -> DataFrame:
    """Messages and next offset per topic partition."""
    return messages.groupBy("partition").agg(
        F.count("*").alias("messages"), (F.max("offset") + 1).alias("next_offset"))
