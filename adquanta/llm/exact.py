"""Exact duplicates through an extendible-hash index on shared files, in DataFrame operations only.

Every text has a 64-bit key. A directory of key prefixes names the bucket of a
key; while a bucket holds more distinct keys than its capacity it is split in
two, and the directory doubles when the bucket was as deep as the directory.
Each bucket is a range of keys with one owner task. An owner's entries are the
different texts of its range: equal keys form a chain whose members are told
apart by their bytes, because the text itself is part of the grouping key.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, stage
from .words import unused

CAPACITY = 100_000  # distinct keys a bucket may hold
MAX_DEPTH = 14      # the directory has at most 2**14 entries


def normalised(text_col: str) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # lower() is the same for ASCII texts and much faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, upper, upper.lower()))


def split_directory(counts: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Bucket of each directory entry, from the numbers of keys at prefixes of ``depth`` bits.

    The list has 2**g entries, g being the depth of the deepest bucket; a bucket
    is named after the first full-depth prefix of its range.
    """
    entries = [0]
    local = {0: 0}
    totals = {0: sum(counts.values())}
    sums = {depth: counts}
    for d in range(depth - 1, -1, -1):
        sums[d] = {}
        for prefix, n in sums[d + 1].items():
            sums[d][prefix >> 1] = sums[d].get(prefix >> 1, 0) + n
    full = [0]
    while full:
        bucket = full.pop()
        if totals[bucket] <= capacity or local[bucket] == depth:
            continue
        if 1 << local[bucket] == len(entries):
            entries = [b for b in entries for _ in range(2)]
        deeper = local[bucket] + 1
        left = bucket >> (depth - deeper)
        other = (left + 1) << (depth - deeper)
        mine = [i for i, b in enumerate(entries) if b == bucket]
        for i in mine[len(mine) // 2:]:
            entries[i] = other
        for name, prefix in ((bucket, left), (other, left + 1)):
            local[name], totals[name] = deeper, sums[deeper].get(prefix, 0)
            full.append(name)
    return entries


def bucket_of(key: Column, entries: list[int]) -> Column:
    """The bucket that the directory names for a key."""
    depth = len(entries).bit_length() - 1
    if not depth:
        return F.lit(entries[0])
    directory = F.from_json(F.lit(json.dumps(entries)), "array<int>")
    return F.element_at(directory, (F.shiftrightunsigned(key, 64 - depth) + 1).cast("int"))


def build_index(docs: DataFrame, entries: list[int], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One entry per different text: bucket, key, digest, keep_id, group_size.

    Copies are combined in the scan tasks before the shuffle, so that a text
    which fills a third of the table sends one row a task.
    """
    text = normalised(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = F.xxhash64("text")
    chained = (
        keyed.groupBy(bucket_of(key, entries).alias("bucket"), key.alias("key"), "text")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("bucket", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                "keep_id", "group_size")
    )
    path = fresh_path(docs.sparkSession, "exact-index")
    chained.repartition("bucket").sortWithinPartitions("bucket", "key") \
        .write.partitionBy("bucket").parquet(path)
    schema = chained.schema
    return docs.sparkSession.read.schema(schema).parquet(path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per row: the id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The largest id of equal texts stays; null ids lose against any other, and
    a group of null ids keeps null. Rows that repeat id and text cannot be told
    apart and get the same answer. Other columns are not looked at. An empty
    table gives no rows.
    """
    text = normalised(text_col)
    keyed = stage(
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .select("id", F.xxhash64("text").alias("key"),
                F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "exact-keys")
    prefix = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    counts = keyed.select("key").distinct().groupBy(prefix.alias("p")).count()
    # At most 2**max_depth rows reach the driver.
    entries = split_directory({r["p"]: r["count"] for r in counts.collect()}, max_depth, capacity)
    index = build_index(docs, entries, id_col, text_col)
    found = keyed.withColumn("bucket", bucket_of(F.col("key"), entries)).join(
        index.hint("merge"), ["bucket", "key", "text_sha256"])
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    verdict = exact_duplicates(docs, id_col, text_col).where("kept")
    name, digest = unused("_keep_id", docs.columns), unused("_sha", docs.columns)
    kept = verdict.select(F.col(id_col).alias(name), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(normalised(text_col).cast("binary"), 256)
    return docs.join(kept.hint("merge"), docs[id_col].eqNullSafe(kept[name]) & (sha == kept[digest]), "left_semi")
