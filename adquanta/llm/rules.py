"""Quality rules whose cutoffs are certified on labelled documents.

A cutoff may be used in a stratum only if an exact binomial test on the good
labelled documents of that stratum shows that it rejects few of them. All tests
of all strata, measures and cutoffs share one error budget.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import Words, chunks, cover, mix, powers, split_words

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
ALPHA = 0.05   # at most this share of good documents of a stratum may be rejected, all rules together
DELTA = 0.05   # chance that any of the guarantees fails
# Word counts at which the next stratum starts.
STRATA = (0, 200, 800)

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_UPPER = np.zeros(256, np.int64)
_IS_UPPER[ord("A"):ord("Z") + 1] = 1


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and how many of them equal an earlier line."""
    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.sort(np.concatenate((w.bounds[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((w.bounds[1:], breaks)), kind="stable")
    words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    starts, ends = starts[words > 0], ends[words > 0]
    doc = np.searchsorted(w.bounds, starts, "right") - 1
    up, down = powers(len(w.data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64),
                            np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    key = mix((total[ends] - total[starts]) * down[starts]) ^ mix(doc.astype(np.uint64) + np.uint64(7))
    _, first = np.unique(key, return_index=True)
    n = np.bincount(doc, minlength=w.n_docs)
    return n, n - np.bincount(doc[first], minlength=w.n_docs)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of every text of an array."""
    w = split_words(texts)
    in_word = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(in_word, w.starts, 1)
    np.add.at(in_word, w.ends, -1)
    inside = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    at, key = w.windows(w.hashes(), 3)
    twice = at[repeated(key ^ mix(w.doc[at].astype(np.uint64) + np.uint64(7)))]
    covered = cover(twice, twice + 3, len(w.starts))
    n_lines, n_dup = _lines(w)
    return {
        "n_words": w.counts,
        "word_chars": _per_text(inside & ((w.data & 0xC0) != 0x80), w.bounds),
        "n_symbols": _per_text(_IS_SYMBOL[w.data], w.bounds),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(w.doc[covered], minlength=w.n_docs),
        "n_upper": _per_text(_IS_UPPER[w.data], w.bounds),
    }


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the base counts of every row, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                got = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(got[c].astype(np.int64)) for c in STATS)],
                    ["id", *STATS])

    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in STATS)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Measure:
    """A ratio and the cutoffs that may be tested; a document is rejected above its cutoff."""

    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]

    def value(self) -> Column:
        return F.coalesce(F.try_divide(F.col(self.top), F.col(self.bottom)), F.lit(0.0))


GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
MEASURES = (
    Measure("symbols_per_word", "n_symbols", "n_words", GRID),
    Measure("duplicate_lines", "n_dup_lines", "n_lines", GRID),
    Measure("repeated_words", "n_repeat_words", "n_words", GRID),
    Measure("capitals", "n_upper", "word_chars", GRID),
    Measure("word_length", "word_chars", "n_words", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
)


def tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for a binomial X of ``n`` trials with chance ``p``; exact up to rounding."""
    if k >= n:
        return 1.0
    if k >= n * p:  # more than about half: no rejection rate that high is ever certified
        return 0.5
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def stratum() -> Column:
    """Number of the stratum by word count."""
    out = F.lit(0)
    for i, start in enumerate(STRATA):
        out = F.when(F.col("n_words") >= start, i).otherwise(out)
    return out


def certified_cutoffs(labelled: DataFrame, measures: tuple[Measure, ...] = MEASURES,
                      alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """The cutoff of each (stratum, measure) that has a certified and useful one.

    ``labelled`` has the base counts, ``stratum`` and ``y`` (1 good). One
    aggregate counts, for every cutoff, the good and bad documents above it. A
    cutoff is certified if, were its true false rejection rate above alpha /
    measures, so few rejected good documents would have a chance below
    delta / tests. Of the certified cutoffs the one that separates best is
    taken; none if none rejects a larger share of bad than of good ones.
    """
    above = [F.sum((m.value() > c).cast("bigint")).alias(f"{m.name}>{c}")
             for m in measures for c in m.cutoffs]
    rows = labelled.groupBy("stratum", "y").agg(F.count("*").alias("n"), *above).collect()
    counts = {(r["stratum"], r["y"]): r for r in rows}  # two rows a stratum
    tests = len(STRATA) * sum(len(m.cutoffs) for m in measures)
    chosen = {}
    for s in range(len(STRATA)):
        good, bad = counts.get((s, 1)), counts.get((s, 0))
        if not good or not bad:
            continue
        for m in measures:
            best = 0.0
            for c in m.cutoffs:
                k = good[f"{m.name}>{c}"]
                gain = bad[f"{m.name}>{c}"] / bad["n"] - k / good["n"]
                if gain > best and tail(good["n"], k, alpha / len(measures)) <= delta / tests:
                    best, chosen[s, m.name] = gain, c
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, base counts, base_failed, stratum, rejected_by, kept.

    Base rules: at least 50 words, at most half of them in repeated windows of
    three. ``rejected_by`` names the certified measures above their cutoff. All
    labelled documents count; contradicting or null labels do not. Null and
    empty texts have zero counts and fail. Repeated rows get equal answers;
    other columns are not looked at; an empty table gives no rows, and without
    labels only the base rules hold.
    """
    stats = stage(text_stats(docs, id_col, text_col).withColumn("stratum", stratum()), "text-stats")
    known = (
        labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias(id_col))
        .agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").drop("_y")
    )
    cutoffs = certified_cutoffs(stats.join(known, id_col), alpha=alpha, delta=delta)
    hits = [F.when((F.col("stratum") == s) & (m.value() > cutoffs[s, m.name]), F.lit(m.name))
            for m in MEASURES for s in range(len(STRATA)) if (s, m.name) in cutoffs]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reasons = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return (
        stats.withColumn("base_failed", failed).withColumn("rejected_by", reasons)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    )
