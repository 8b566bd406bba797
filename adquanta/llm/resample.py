"""Importance resampling toward a target distribution, ranked by a distributed radix sort.

Hashed word n-grams of the corpus and of the target give one gain a bucket. A
document's weight is the sum of its features' gains, looked up in an array; a
seeded Gumbel number turns weights into a draw without replacement. The draw
takes the highest scores, so scores are ranked: least significant digits first,
each pass a stable counting sort whose destinations come from global prefix
sums of digit counts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stage
from .words import _LOWER, Words, chunks, split_words, unused

BUCKETS = 10_000
ORDER = 3             # features are runs of one to this many words
PERCENT = 5
MIN_WORDS = 20
SEED = "42"
DIGIT_BITS = 11       # a pass counts at most 2**11 digits
SLICE_ROWS = 1 << 15  # rows that are counted as one slice of a pass

# Words are runs of digits, letters and bytes beyond ASCII.
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x80:] = False
for _first, _last in ("09", "AZ", "az"):
    _BETWEEN[ord(_first):ord(_last) + 1] = False

LONG = 64   # bytes; longer words are summed one by one

_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
# State tables without the inversions that zlib puts around a checksum.
_STEP = _CRC ^ _CRC[0]


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """What ``n`` more bytes make of a checksum's four bytes, as four tables."""
    image = np.uint32(1) << np.arange(32, dtype=np.uint32)
    power, result = image.copy(), None

    def apply(bits: np.ndarray, states: np.ndarray) -> np.ndarray:
        has = (states[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(np.where(has == 1, bits, np.uint32(0)), axis=1)

    power = _STEP[power & 0xFF] ^ (power >> np.uint32(8))
    while n:
        if n & 1:
            result = power if result is None else apply(power, result)
        n >>= 1
        if n:
            power = apply(power, power)
    bits = image if result is None else result
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([apply(bits, byte << np.uint32(8 * i)) for i in range(4)])


def _followed(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums carried over ``lengths`` bytes to come."""
    if not len(sums):
        return sums
    known, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in known])
    out = np.zeros(len(sums), np.uint32)
    for i in range(4):
        out ^= tables[which, i, (sums >> np.uint32(8 * i)) & np.uint32(0xFF)]
    return out


def word_sums(w: Words) -> np.ndarray:
    """CRC-32 of each word's bytes, A-Z lower-cased."""
    data = _LOWER[w.data]
    lengths = w.ends - w.starts
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = w.starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-sizes, -LONG))
    for step in range(int(sizes[long]) if long < len(sizes) else 0):
        # The words that still have a byte lead the order.
        live = slice(long, int(np.searchsorted(-sizes, -step)))
        byte = data[starts[live] + step]
        state[live] = _STEP[(state[live] ^ byte) & 0xFF] ^ (state[live] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[w.starts[i]:w.ends[i]])
    return out


def feature_buckets(w: Words, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every run of one to ``order`` words, joined by single spaces."""
    lengths, sums = w.ends - w.starts, word_sums(w)
    space = np.full(len(sums), zlib.crc32(b" "), np.uint32)
    led = _followed(space, lengths) ^ sums     # of a space and the word
    docs, found = [w.doc], [sums]
    for n in range(1, order):
        at = np.flatnonzero(w.doc[:max(len(sums) - n, 0)] == w.doc[n:])
        run = found[-1]
        if n > 1:                              # runs of n words start where ``found[-1]`` says
            longer = np.zeros(len(sums), np.uint32)
            longer[before] = run
            run = longer
        found.append(_followed(run[at], lengths[at + n] + 1) ^ led[at + n])
        docs.append(w.doc[at])
        before = at
    return np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS,
                  order: int = ORDER) -> np.ndarray:
    """Features of all texts per bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, text_col):
                _, bucket = feature_buckets(split_words(part.column(text_col), _BETWEEN), buckets, order)
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(text_col).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of a feature in each bucket, in thousandths, with one added to every count."""
    every, wanted = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * wanted)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _gumbel(key: str) -> int:
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                      order: int = ORDER, seed: str = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                w = split_words(part.column(text_col), _BETWEEN)
                doc, bucket = feature_buckets(w, len(gains), order)
                by_doc = np.argsort(doc, kind="stable")
                edge = np.searchsorted(doc[by_doc], np.arange(w.n_docs + 1))
                total = np.concatenate((np.zeros(1, np.int64), np.cumsum(gains[bucket[by_doc]])))
                weight = total[edge[1:]] - total[edge[:-1]]
                ids = part.column(id_col)
                drawn = np.array([_gumbel(f"{seed}:{'' if i is None else i}") for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(w.counts.astype(np.int64)), pa.array(np.diff(edge).astype(np.int64)),
                     pa.array(weight), pa.array(weight + drawn)],
                    [id_col, "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _digits(low: int, high: int, value: Column, descending: bool, bits: int) -> list[Column]:
    """Digits of a key between ``low`` and ``high``, the least significant first."""
    if high - low < 1 << 63:
        key = F.lit(high) - value if descending else value - F.lit(low)
        size = (high - low).bit_length()
    else:   # the differences do not fit, the bits of unsigned keys do
        key = value.bitwiseXOR(F.lit(-(1 << 63)))
        key, size = F.bitwise_not(key) if descending else key, 64
    n = -(-size // bits)
    width = -(-size // n) if n else 0
    return [F.shiftrightunsigned(key, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(n)]


def radix_positions(rows: DataFrame, keys: list[tuple[str, bool]], position: str,
                    digit_bits: int = DIGIT_BITS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with their position, from 0, in the order of ``keys`` (name, descending).

    Keys are long columns, the most significant first; nulls come last. Passes
    go from the least significant digit to the most significant. In each, a row
    moves behind all rows of smaller digits, all rows of its digit in earlier
    slices and those before it in its own slice. So a pass counts digits per
    slice, adds the counts up over slices within each digit, and joins rows with
    their slice's offset. A group of the join is at most one slice, however
    often a digit occurs. Rows equal in all keys stand in any, but one, order.
    """
    spark = rows.sparkSession
    part, digit, start = (unused(x, rows.columns) for x in ("_part", "_digit", "_start"))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    ends = rows.agg(F.count("*"), *[f(F.col(f"`{k}`").cast("bigint")) for k, _ in keys for f in (F.min, F.max)],
                    *[F.count_if(F.col(f"`{k}`").isNull()) for k, _ in keys]).first()
    n_slices = max(1, -(-ends[0] // slice_rows))
    mixed = F.xxhash64(*columns)
    state = stage(rows.select(*columns, F.pmod(mixed, F.lit(n_slices)).alias(part), mixed.alias(position)), "radix")
    passes = []
    for i, (key, descending) in reversed(list(enumerate(keys))):
        low, high, nulls = ends[1 + 2 * i], ends[2 + 2 * i], ends[1 + 2 * len(keys) + i]
        if low is not None:
            value = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(low))
            passes += _digits(low, high, value, descending, digit_bits)
        if nulls:
            passes.append(F.col(f"`{key}`").isNull().cast("bigint"))
    for turn in passes or [F.lit(0).cast("bigint")]:
        tagged = state.withColumn(digit, turn)
        counts = stage(tagged.groupBy(part, digit).agg(F.count("*").alias("n")), "radix-counts")
        totals = counts.groupBy(digit).agg(F.sum("n").alias("n")).collect()   # at most 2**digit_bits rows
        base, before = [], 0
        for row in sorted(totals, key=lambda r: r[digit]):
            base.append((row[digit], before))
            before += row["n"]
        bases = F.broadcast(spark.createDataFrame(base, f"`{digit}` bigint, _base bigint"))
        earlier = Window.partitionBy(digit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.join(bases, digit).select(
            part, digit, (F.col("_base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias(start))
        inside = Window.partitionBy(part, digit).orderBy(position)
        moved = tagged.join(offsets.hint("merge"), [part, digit]).select(
            *columns, (F.col(start) + F.row_number().over(inside) - 1).alias(position))
        after = stage(moved.withColumn(part, F.floor(F.col(position) / slice_rows)), "radix")
        for done in (state, counts):
            discard(done)
        state = after
    return state.drop(part)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, order: int = ORDER,
             seed: str = SEED, target_col: str = "text", digit_bits: int = DIGIT_BITS,
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per row of ``docs``: its id, n_features, weight, score and rank in the draw.

    Of the rows with at least ``min_words`` words ``percent`` in a hundred are
    drawn, rounded down: the highest scores, ties to the smaller id. Rank runs
    from 1 in that order and is null for rows not drawn. Ids are integers; null
    ids come after others of equal score and draw as the empty text. Null and
    empty texts have no features and weight 0. Rows that repeat an id count as
    rows of their own. Empty tables give no rows; without a target all of its
    counts are 0. Other columns are not looked at.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, order),
                         bucket_counts(target, target_col, buckets, order))
    scored = stage(importance_scores(docs, gains, id_col, text_col, order, seed), "scores")
    able = scored.where(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    position = unused("_position", scored.columns)
    placed = radix_positions(able, [("score", True), (id_col, False)], position, digit_bits, slice_rows)
    rank = F.when(F.col(position) < draw, F.col(position) + 1).alias("rank")
    columns = [F.col(f"`{id_col}`"), "n_features", "weight", "score"]
    others = scored.where(F.col("n_words") < min_words)
    return placed.select(*columns, rank).unionByName(others.select(*columns, F.lit(None).cast("bigint").alias("rank")))
