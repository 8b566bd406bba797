"""Windows of consecutive words grouped by their minimiser.

The minimiser of a window is its ``k``-word run with the smallest hash (the
leftmost of equals). It depends on the window's words alone, so equal windows
have equal minimisers wherever they stand. Neighbouring windows with the same
minimiser position form a segment; a window can repeat only where its
minimiser does, so only segments with a repeated minimiser need a closer look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import Words, chunks, mix, powers, signed, split_words

_POSITION = np.uint64((1 << 24) - 1)


@dataclass
class Segments:
    """Flat segments: windows ``start``..``stop - 1`` (first words) share minimiser ``at``."""

    start: np.ndarray
    stop: np.ndarray
    at: np.ndarray
    key: np.ndarray   # hash of the minimiser's words
    doc: np.ndarray


def minimiser_segments(w: Words, hashes: np.ndarray, window: int, k: int) -> Segments:
    """Segments of all texts of a batch, over word numbers of the batch."""
    none = np.zeros(0, np.int64)
    n_runs, width = len(hashes) - k + 1, window - k + 1
    if len(hashes) < window:
        return Segments(none, none, none, none, none)
    at, key = w.windows(hashes, k)
    order = np.full(n_runs, ~np.uint64(0))
    # A hash and, for ties, the position; batches hold fewer than 2**24 words,
    # longer texts wrap without harm because a window is short.
    order[at] = (key & ~_POSITION) | (at.astype(np.uint64) & _POSITION)
    full = np.zeros(n_runs, np.uint64)
    full[at] = key
    low, span = order, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    valid = np.flatnonzero(w.doc[:len(low)] == w.doc[window - 1:])
    if not len(valid):
        return Segments(none, none, none, none, none)
    chosen = low[valid]
    spot = valid + ((chosen - valid.astype(np.uint64)) & _POSITION).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (valid[1:] != valid[:-1] + 1)
    head = np.flatnonzero(new)
    stop = np.append(valid[head[1:] - 1], valid[-1]) + 1
    start = valid[head]
    return Segments(start, stop, spot[head], signed(full[spot[head]]), w.doc[start])


def text_slices(w: Words, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The bytes from word ``first`` to the end of word ``last``, separators included."""
    lo, hi = w.starts[first], w.ends[last]
    lengths = hi - lo
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    index = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], lengths)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lo), [None, pa.py_buffer(offsets.astype(np.int64)),
                                     pa.py_buffer(w.data[index].tobytes())]).cast(pa.binary())


def segment_digests(h: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the words ``first``..``last`` and of the place of ``at`` among them."""
    up, down = powers(len(h) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1])))
    return mix((total[last + 1] - total[first]) * down[first] + (at - first).astype(np.uint64))


def minimiser_keys(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The different minimisers of each block of texts: block, key, n, marks, ids, segments.

    A block is what a task reads at once. ``ids`` and ``segments`` are arrays of
    the ``n`` places of a minimiser; segments of a text are numbered from 0.
    ``marks`` has the lowest bit set in the digest of each segment's words: the
    marks of many different segments together tell about how many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first_block()
        for batch in batches:
            for part in chunks(batch, "text"):
                block += 1
                w = split_words(part.column("text"))
                h = w.hashes()
                s = minimiser_segments(w, h, window, k)
                digest = segment_digests(h, s.start, s.stop + window - 2, s.at)
                mark = digest & (~digest + np.uint64(1))
                number = np.arange(len(s.doc)) - np.searchsorted(s.doc, np.arange(w.n_docs + 1))[s.doc]
                order = np.argsort(s.key, kind="stable")
                key = s.key[order]
                head = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
                bounds = np.append(head, len(key)).astype(np.int32)
                marks = np.bitwise_or.reduceat(mark[order], head) if len(head) else mark
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(head), block)), pa.array(key[head]),
                     pa.array(np.diff(bounds).astype(np.int64)), pa.array(signed(marks)),
                     pa.ListArray.from_arrays(pa.array(bounds), part.column("id").take(pa.array(s.doc[order]))),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(number[order].astype(np.int32)))],
                    ["block", "key", "n", "marks", "ids", "segments"])

    return docs.select("id", "text").mapInArrow(
        run, "block bigint, key bigint, n bigint, marks bigint, ids array<bigint>, segments array<int>")


def first_block() -> int:
    """A number in a task from which its blocks are numbered."""
    return TaskContext.get().partitionId() << 40


def by_text(table: pa.Table, place: str, shared: str, out: str) -> pa.Table:
    """(id, ``out``) of the texts of one block.

    Rows of ``table`` have arrays ``ids`` and ``place`` of equal length, and one
    value of ``shared`` for all of them; each text gets its pairs of both.
    """
    ids = table["ids"].combine_chunks()
    row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(ids.offsets)))
    flat, places = np.asarray(ids.flatten()), np.asarray(table[place].combine_chunks().flatten())
    order = np.lexsort((places, flat))
    flat, places, row = flat[order], places[order], row[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(len(flat), 1), bool), flat[1:] != flat[:-1])))
    pairs = pa.StructArray.from_arrays(
        [pa.array(places), table[shared].combine_chunks().take(pa.array(row))], [place, shared])
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(flat)).astype(np.int32)), pairs)
    return pa.table({"id": pa.array(flat[head]), out: lists})


def repeated_segments(docs: DataFrame, window: int, k: int, many: int) -> DataFrame:
    """Per id: the numbers of its segments whose minimiser occurs twice or more.

    ``varied`` tells minimisers of about ``many`` (a power of two) or more
    different segments: all marks below ``many`` have been seen. Copies of one
    segment have one mark, so their number does not matter; nor does it for the
    join, where a minimiser is one row a block. Counts and marks are combined
    before the shuffle, and staged so that the join deals both sides anew:
    adaptive execution can then split a key of many rows.
    """
    keys = minimiser_keys(docs, window, k)
    full = F.col("marks").bitwiseAND(F.lit(many - 1)) == many - 1
    often = stage(keys.groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("marks").alias("marks"))
                  .where("n > 1").select("key", full.alias("varied")), "minimisers")
    met = keys.select("block", "key", "ids", "segments").join(often.hint("merge"), "key")
    hits = met.select("block", "ids", "segments", "varied").groupBy("block").applyInArrow(
        lambda table: by_text(table, "segments", "varied", "hits"),
        "id bigint, hits array<struct<segments: int, varied: boolean>>")
    # Rows that agree in id and text have the same segments in each block that holds one.
    return hits.groupBy("id").agg(F.first("hits").alias("hits"))
