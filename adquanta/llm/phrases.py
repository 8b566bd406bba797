"""Phrases of two to five words that occur far more often than their parts suggest.

Only the longest windows are counted: each word and the four that follow it in
its piece, padded with nulls behind the piece's end. ROLLUP over their columns
sums windows with a common beginning, so one aggregate gives the count of every
shorter phrase, and of all words. What surely occurs less often than a phrase
must is padded away beforehand: two tables of hashed counts, in which no phrase
ever counts less than it occurs, tell where a window may stop early. The first
is of words and pairs, the second of longer runs whose pairs the first lets pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .words import _LOWER, Words, chunks, mix, split_words

LONGEST = 5
LEAST = 100        # occurrences of a phrase
TOP = 2_000        # phrases a language
PERCENT = 100      # a phrase goes if a longer one occurs at least so often, in hundredths
SLOTS_LOG2 = 26    # hashed counts: one byte each in a task, one bit each in a broadcast table (8 MB)
SLICE = 1 << 18    # slots that travel together
LEVELS = ((1, 2), (3, 4, 5))   # sizes of the runs that each table counts
LOT_BYTES = 1 << 20   # text whose windows are combined before they leave the task
SHARES = 64        # in which the phrases of a language are dealt out
NO_LANG = "und"

_END = np.zeros(256, bool)
_END[list(b".,;:!?\x0A\x0B\x0C\x0D")] = True
_BETWEEN = _END.copy()
_BETWEEN[[0x20, 0x09]] = True


def _pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words, and for each how many words of its piece stand from it on (at most ``LONGEST``)."""
    w = split_words(texts, _BETWEEN)
    n = len(w.starts)
    ends = np.concatenate(([0], np.cumsum(_END[w.data])))
    piece = ends[w.starts]
    ahead = np.ones(n, np.int64)
    for k in range(1, LONGEST):
        ahead[:max(n - k, 0)] += (w.doc[k:] == w.doc[:max(n - k, 0)]) & (piece[k:] == piece[:max(n - k, 0)])
    return w, ahead


def _slots(state: np.ndarray, words: np.ndarray, ahead: np.ndarray, k: int, slots: int) -> np.ndarray:
    """Extends the hashes ``state`` of k-1 words from each position by the k-th, in place.

    Returns their slots, -1 where the piece ends before the k-th word.
    """
    last = len(state) - k + 1
    if last > 0:
        state[:last] = mix(state[:last] * np.uint64(0x9E3779B97F4A7C15) + words[k - 1:])
    return np.where(ahead >= k, (state & np.uint64(slots - 1)).astype(np.int64), -1)


def _states(w: Words, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the hash of its language."""
    own = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
    return w.hashes(lower=True), own[w.doc] if len(w.doc) else np.zeros(0, np.uint64)


def _langs(part: pa.RecordBatch) -> list[str]:
    return [NO_LANG if x is None else x for x in part.column("lang").to_pylist()]


def _reach(state: np.ndarray, words: np.ndarray, ahead: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """How many words from each position on may belong to one phrase, by the given tables' bits.

    Extends ``state`` by the runs that the tables know.
    """
    reach, k = np.zeros(len(ahead), np.int64), 0
    for bits, sizes in zip(tables, LEVELS):
        for k in sizes:
            at = _slots(state, words, ahead, k, len(bits) * 8)
            often = (at >= 0) & ((bits[at >> 3] >> (7 - (at & 7))) & 1 == 1)
            reach[often & (reach == k - 1)] = k
    if k == 2:
        # A longer run may stand where all of its pairs may.
        for more in range(k + 1, LONGEST + 1):
            last = len(reach) - more + k
            further = np.zeros(len(reach), bool)
            further[:max(last, 0)] = reach[more - k:] >= k
            reach[further & (reach == more - 1) & (ahead >= more)] = more
    return reach


def frequent_slots(rows: DataFrame, least: int, slots_log2: int, tables: list[np.ndarray]) -> np.ndarray:
    """One bit a slot: whether the runs hashed to it occur ``least`` times or more together.

    Counts runs of the sizes of the next of ``LEVELS``, those that ``tables`` of
    the levels before let pass. Each task counts into an array of its own and
    sends it in compressed slices, cut off at 255, which is enough to tell.
    Slices are added up as they stream in; the driver gets one bit a slot,
    whatever the size of the corpus.
    """
    slots = 1 << slots_log2
    size = min(SLICE, slots)
    top = min(least, 255)
    sizes = LEVELS[len(tables)]
    given = rows.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint8)
        for batch in batches:
            for part in chunks(batch, "text"):
                w, ahead = _pieces(part.column("text"))
                words, state = _states(w, _langs(part))
                reach = _reach(state, words, ahead, given.value) if given.value else ahead
                found = [at[at >= 0] for k in sizes for at in [_slots(state, words, reach, k, slots)]]
                spot, n = np.unique(np.concatenate(found), return_counts=True)
                total[spot] = np.minimum(total[spot] + np.minimum(n, 255), 255)
        pack = zstandard.ZstdCompressor(level=1)
        cut = total.reshape(-1, size)
        some = np.flatnonzero(cut.any(axis=1))
        for lo in range(0, len(some), 16):
            group = some[lo:lo + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array([pack.compress(cut[i].tobytes()) for i in group], pa.binary())],
                ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                part = np.frombuffer(unpack.decompress(counts.as_py()), np.uint8)
                # Sums stop at 255 as well.
                before = total.get(number, np.zeros(1, np.uint8))
                total[number] = before + np.minimum(part, np.uint8(255) - before)
        for number, counts in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([np.packbits(counts >= top).tobytes()], pa.binary())],
                ["slice", "bits"])

    sent = rows.mapInArrow(count, "slice bigint, counts binary")
    bits = np.zeros((slots // size, size // 8), np.uint8)
    for row in sent.repartition("slice").mapInArrow(add, "slice bigint, bits binary").toLocalIterator():
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    given.unpersist()
    return bits.ravel()


def _combined(code: np.ndarray, ahead: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of word numbers cut to ``ahead`` words: per length the distinct ones' first words and counts.

    Numbers of longer beginnings are made from those of shorter ones, so equal
    numbers mean equal words.
    """
    n = len(code)
    name = code.astype(np.int64)
    for k in range(1, LONGEST + 1):
        here = np.flatnonzero(ahead == k)
        if len(here):
            _, first, count = np.unique(name[here], return_index=True, return_counts=True)
            yield k, here[first], count
        if k == LONGEST:
            break
        more = np.flatnonzero(ahead > k)
        if not len(more):
            break
        _, number = np.unique(name[more] * np.int64(n + 1) + code[more + k], return_inverse=True)
        name[more] = number


def window_counts(rows: DataFrame, tables: list[np.ndarray], lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(lang, w1..w5, n): distinct padded windows; those of rare words have no word at all."""
    given = rows.sparkSession.sparkContext.broadcast(tables)
    names = [f"w{i}" for i in range(1, LONGEST + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", lot_bytes):
                w, ahead = _pieces(part.column("text"))
                if not len(w.starts):
                    continue
                lang = _langs(part)
                words, state = _states(w, lang)
                reach = _reach(state, words, ahead, given.value)
                yield from _windows(w, lang, reach)

    def _windows(w: Words, lang: list[str], reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        text = pa.StringArray.from_buffers(
            len(w.starts), *_joined(_LOWER[w.data], w.starts, w.ends)).dictionary_encode()
        code = np.asarray(text.indices, np.int64)
        kinds, number = np.unique(np.array(lang), return_inverse=True)
        of = number[w.doc]
        for i, kind in enumerate(kinds.tolist()):
            own = np.where(of == i, reach, -1)
            none = int((own == 0).sum())
            if none:
                yield _batch(kind, [pa.nulls(1, pa.string())] * LONGEST, np.array([none]))
            for k, first, count in _combined(code, own):
                columns = [text.dictionary.take(pa.array(code[first + j])) if j < k
                           else pa.nulls(len(first), pa.string()) for j in range(LONGEST)]
                yield _batch(kind, columns, count)

    def _batch(kind: str, columns: list[pa.Array], count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(count), pa.string()), *columns, pa.array(count.astype(np.int64))],
            ["lang", *names, "n"])

    schema = ", ".join(f"{c} string" for c in ("lang", *names))
    return rows.mapInArrow(run, f"{schema}, n bigint").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Buffer, pa.Buffer]:
    """Offsets and bytes of the words behind one another."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index].tobytes())


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(lang, words, n) of all phrases with ``least`` occurrences, and of no words: all of the language."""
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # The level has a bit set for each column that is summed over; padded prefixes are no phrases.
    size = F.lit(LONGEST) - F.bit_count("level")
    words = F.filter(F.slice(F.array(*names), 1, F.greatest(size, F.lit(0))), lambda x: x.isNotNull())
    return sums.where(size >= 0).select("lang", words.alias("words"), size.alias("size"), "n").where(
        (F.col("size") == 0) | ((F.size("words") == F.col("size")) & (F.col("n") >= least)))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 top: int = TOP, percent: int = PERCENT, slots_log2: int = SLOTS_LOG2) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at punctuation and line ends into pieces
    and at spaces and tabs into words. Phrases of two to five words that occur
    ``least`` times (a) are scored at their worst cut into parts that occur l and
    r times: floor(1000 * a * n / (l * r)), n being the words of the language.
    Those inside a longer one with ``percent`` hundredths of their occurrences
    go. Ranked by score, a, then the phrase's bytes. Null texts have no words; a
    null language is called ``und``, as its own name is. Repeated rows count
    again. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    tables: list[np.ndarray] = []
    for _ in LEVELS:
        tables.append(frequent_slots(rows, least, slots_log2, tables))
    windows = window_counts(rows, tables)
    counts = stage(phrase_counts(windows, least).withColumn("phrase", F.array_join("words", " ")), "phrases")
    # One row a language and share, so that phrases of one language meet it in many tasks.
    totals = counts.where("size = 0").select(
        "lang", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).cast("int")
    known = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "phrase", "words", "size", F.col("n").alias("a"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    covered = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))

    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "a", "words", "size", cut).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"),
        part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))

    def times(side: str, name: str) -> DataFrame:
        return known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)).hint("merge")

    ratio = F.expr("(1000BD * cast(a AS decimal(16, 0)) * cast(total AS decimal(17, 0)))"
                   " div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    scored = cuts.join(times("left", "l"), ["lang", "left"]).join(times("right", "r"), ["lang", "right"]) \
        .withColumn("share", share).join(totals, ["lang", "share"]).withColumn("score", ratio)
    worst = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("best")).select(
        "lang", "phrase", "best.*")
    kept = stage(worst.join(covered.hint("merge"), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer", "cut"), "scored")

    # A language's best are among the best of its shares, so no task ranks all of them.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
