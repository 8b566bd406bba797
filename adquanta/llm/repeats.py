"""Removal of word runs that occur more than once in a corpus.

Windows of ``window`` words are judged. Texts are cut into minimiser segments;
those with a repeated minimiser travel as pieces of text to the shard of their
minimiser, where a finder decides which windows repeat. Equal pieces are one row
for all texts that a task reads together, and one in the shard, so a passage of
many texts costs as much as its different pieces. The answers return to the
documents as ranges of words. A finder never sees a whole corpus: what may be
equal meets in one shard, and shards are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .segments import by_text, first_block, minimiser_segments, repeated_segments, segment_digests, text_slices
from .words import Words, chunks, cover, kept_text, mix, signed, split_words, unused

SHARD_BYTES = 2 << 20
# A minimiser of about so many different segments is dealt out by whole windows in place of itself.
VARIED = 1 << 13

# (words, word hashes, minimiser word of each piece, copies of each piece, window)
# -> for each word number whether the window that starts there repeats.
Finder = Callable[[Words, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` and ``text``: rows are told apart by a 64-bit digest of id and text.

    Rows that agree in both are equal, so they share their answers.
    """
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("id"), F.col(text_col).alias("text"))


def _pieces(docs: DataFrame, window: int, k: int, many: int) -> DataFrame:
    """Different text pieces of all segments with a repeated minimiser, per block of texts.

    block, at (minimiser, from the piece's first word), key (routes equal windows
    to one shard), digest, piece, and where it stands: ids and firsts (word
    numbers in the documents), arrays of equal length. A block is what a task
    reads at once. Only short rows are gathered per document; texts are joined once.
    """
    hits = repeated_segments(docs, window, k, many)
    joined = docs.join(hits.hint("merge"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first_block()
        for batch in batches:
            for part in chunks(batch, "text"):
                block += 1
                w = split_words(part.column("text"))
                h = w.hashes()
                s = minimiser_segments(w, h, window, k)
                base = np.searchsorted(s.doc, np.arange(w.n_docs + 1))
                hits = part.column("hits")
                owner = np.repeat(np.arange(w.n_docs), np.diff(np.asarray(hits.offsets)))
                flat = hits.flatten()
                number = base[owner] + np.asarray(flat.field("segments"), np.int64)
                varied = np.asarray(flat.field("varied").to_numpy(zero_copy_only=False), bool)
                whole, split = np.sort(number[~varied]), np.sort(number[varied])
                # Segments of varied minimisers: every window for itself.
                size = s.stop[split] - s.start[split]
                alone = np.repeat(s.start[split], size) + np.arange(size.sum()) \
                    - np.repeat(np.cumsum(size) - size, size)
                first = np.concatenate((s.start[whole], alone))
                last = np.concatenate((s.stop[whole], alone + 1)) + window - 2
                at = np.concatenate((s.at[whole], np.repeat(s.at[split], size)))
                digest = segment_digests(h, first, last, at)
                key = np.concatenate((s.key[whole], signed(mix(~digest[len(whole):]))))
                # Equal pieces lie together now; the first of each stands for all.
                order = np.lexsort((digest, key))
                first, last, at, digest, key = (x[order] for x in (first, last, at, digest, key))
                new = np.ones(len(first), bool)
                new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                head = np.flatnonzero(new)
                edge = np.append(head, len(first))
                doc = w.doc[first]
                ids, firsts = part.column("id").take(pa.array(doc)), pa.array((first - w.first[doc]).astype(np.int32))
                for lo in range(0, len(head), 20_000):
                    one = head[lo:lo + 20_000]
                    a, b = edge[lo], edge[min(lo + 20_000, len(head))]
                    bounds = pa.array((edge[lo:lo + len(one) + 1] - a).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(one), block)), pa.array((at - first)[one].astype(np.int32)),
                         pa.array(key[one]), pa.array(signed(digest[one])), text_slices(w, first[one], last[one]),
                         pa.ListArray.from_arrays(bounds, ids.slice(a, b - a)),
                         pa.ListArray.from_arrays(bounds, firsts.slice(a, b - a))],
                        ["block", "at", "key", "digest", "piece", "ids", "firsts"])

    return joined.mapInArrow(run, "block bigint, at int, key bigint, digest bigint, piece binary, "
                                  "ids array<bigint>, firsts array<int>")


def _runs(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of the runs of true values that stay in one text."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    head = np.flatnonzero(new)
    return at[head], np.append(at[head[1:] - 1], at[-1]) + 1


def _search(pieces: DataFrame, window: int, find: Finder, shard_bytes: int) -> DataFrame:
    """(key, digest, runs): runs of repeated windows, as start and stop word of the piece in turn."""
    size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    n_shards = max(1, size // shard_bytes)

    # Copies are combined in the scan tasks before they travel.
    unique = pieces.groupBy("key", "digest", "at", "piece").agg(F.sum(F.size("ids")).alias("n"))
    sharded = unique.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)))

    def run(table: pa.Table) -> pa.Table:
        # The same words may stand in several pieces with other white space between them.
        key, digest = np.asarray(table["key"]), np.asarray(table["digest"])
        order = np.lexsort((digest, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(digest[order]) != 0)
        head = np.flatnonzero(new)
        n = np.add.reduceat(np.asarray(table["n"])[order], head)
        table = table.take(pa.array(order[head]))
        w = split_words(table["piece"].combine_chunks().cast(pa.large_binary())
                        .view(pa.large_string()))
        at = w.first[:-1] + np.asarray(table["at"])
        mask = find(w, w.hashes(), at, n, window)
        start, stop = _runs(mask, w.doc)
        piece = w.doc[start]
        flat = np.stack((start - w.first[piece], stop - w.first[piece]), 1).ravel()
        bounds = 2 * np.searchsorted(piece, np.arange(w.n_docs + 1))
        some = pa.array(np.flatnonzero(np.diff(bounds)))
        runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.table({"key": table["key"].take(some), "digest": table["digest"].take(some),
                         "runs": runs.take(some)})

    return sharded.groupBy("shard").applyInArrow(run, "key bigint, digest bigint, runs array<int>")


def repeated_ranges(rows: DataFrame, window: int, k: int, find: Finder,
                    many: int = VARIED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per id of ``rows`` (id, text): ``ranges`` of words in repeated windows; ids without any are absent.

    ``ranges`` holds (firsts, runs) of pieces: windows start at firsts + runs[0]
    up to, not including, firsts + runs[1], and so on.
    """
    pieces = stage(_pieces(rows, window, k, many), "pieces", compression="zstd")
    found = _search(pieces, window, find, shard_bytes)
    placed = pieces.select("block", "key", "digest", "ids", "firsts").join(found.hint("merge"), ["key", "digest"])
    ranges = placed.select("block", "ids", "firsts", "runs").groupBy("block").applyInArrow(
        lambda table: by_text(table, "firsts", "runs", "ranges"), "id bigint, ranges array<struct<firsts: int, runs: array<int>>>")
    # Rows that agree in id and text have the same ranges in each block that holds one.
    return ranges.groupBy("id").agg(F.first("ranges").alias("ranges"))


def _removed(w: Words, ranges: pa.Array, window: int) -> np.ndarray:
    """Which words of a batch lie in the ranges of their text."""
    n = len(w.starts)
    outer = np.asarray(ranges.offsets)
    pieces = ranges.flatten()
    owner = np.repeat(np.arange(w.n_docs), np.diff(outer))
    runs = pieces.field("runs")
    piece = np.repeat(np.arange(len(pieces)), np.diff(np.asarray(runs.offsets)))
    base = (w.first[owner] + np.asarray(pieces.field("firsts"), np.int64))[piece]
    spots = base + np.asarray(runs.flatten(), np.int64)
    return cover(spots[0::2], spots[1::2] + window - 1, n)


def cut_repeats(docs: DataFrame, window: int, k: int, find: Finder, id_col: str = "doc_id",
                text_col: str = "text", digest: bool = False, many: int = VARIED,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove the words of repeated windows from every whole text.

    With ``digest``: id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space). Otherwise all columns of ``docs``; a text that loses
    words is replaced by its kept words joined by one space, others stay as
    they are. Windows are judged on the input. Null texts have no words and
    stay null; an empty table gives no rows; equal rows repeat each other.
    """
    ranges = repeated_ranges(with_rows(docs, id_col, text_col), window, k, find, many, shard_bytes)
    row, spans = unused("_row", docs.columns), unused("_ranges", docs.columns)
    found = ranges.select(F.col("id").alias(row), F.col("ranges").alias(spans))
    kept = [id_col, text_col] if digest else docs.columns
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(F.col(id_col), F.col(text_col)).alias(row))
    joined = plain.join(found.hint("merge"), row, "left").drop(row)
    empty = F.array().cast(found.schema[spans].dataType)
    joined = joined.withColumn(spans, F.coalesce(spans, empty))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                w = split_words(part.column(text_col))
                gone = _removed(w, part.column(spans), window)
                lost = np.bincount(w.doc[gone], minlength=w.n_docs)
                sha = [hashlib.sha256(kept_text(w, d, ~gone)).hexdigest() for d in range(w.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(w.counts.astype(np.int64)),
                     pa.array(lost.astype(np.int64)), pa.array(sha)],
                    [id_col, "n_words", "n_removed", "kept_sha256"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text_col)
        for batch in batches:
            for part in chunks(batch, text_col):
                w = split_words(part.column(text_col))
                gone = _removed(w, part.column(spans), window)
                lost = np.bincount(w.doc[gone], minlength=w.n_docs)
                old = part.column(text_col)
                new = [kept_text(w, d, ~gone).decode() if lost[d] else old[d].as_py()
                       for d in range(w.n_docs)]
                columns = [part.column(c) for c in kept]
                columns[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, kept)

    if digest:
        kind = docs.schema[id_col].dataType.simpleString()
        return joined.mapInArrow(
            digests, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    return joined.mapInArrow(texts, docs.schema)
