"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has three segments that fit the 23 bits of the binary Golay code.
Segments of two fingerprints that differ in few bits have a codeword near both,
so a segment is decoded to the indices of all codewords within four bits, at
most six. As two errors leave one of the three segments untouched, keys pair a
whole segment with a codeword index of the next one. Fingerprints that meet
under a key are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import connected
from .words import _LOWER, Words, chunks, split_words

SHINGLE = 3
SEED = 42
MOST_BITS = 2      # differing bits of a link; the keys below are made for two
FULL = 256         # members of a bucket that are compared pair by pair
BLOCK = 1 << 16    # shingles whose bits are added up at once

LENGTH, MESSAGE = 23, 12             # the Golay code: 23 bits, 12 of them free
# Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
CHECK = LENGTH - MESSAGE
SEGMENTS = ((42, 22), (21, 21), (0, 21))   # lowest bit and size of each segment


def _remainders() -> np.ndarray:
    """Remainder of each single bit modulo the generator."""
    out, value = [], 1
    for _ in range(LENGTH):
        out.append(value)
        value <<= 1
        if value >> CHECK:
            value ^= GENERATOR
    return np.array(out, np.int64)


_BIT = _remainders()


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words; 0 for codewords."""
    out = np.zeros(len(words), np.int64)
    for i in range(LENGTH):
        out ^= np.where((words >> i) & 1, _BIT[i], 0)
    return out


def _near_errors(most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each remainder the error patterns of up to ``most`` bits that leave it, and their number."""
    patterns = np.array([sum(1 << i for i in bits) for n in range(most + 1)
                         for bits in combinations(range(LENGTH), n)], np.int64)
    kind = syndromes(patterns)
    order = np.argsort(kind, kind="stable")
    n = np.bincount(kind, minlength=1 << CHECK)
    table = np.zeros((1 << CHECK, n.max()), np.int64)
    table[kind[order], np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)] = patterns[order]
    return table, n


_ERRORS, _N_ERRORS = _near_errors()


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within four bits of each word (one row each), and how many there are."""
    kind = syndromes(words)
    return (words[:, None] ^ _ERRORS[kind]) >> CHECK, _N_ERRORS[kind]


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of a fingerprint and key, for all keys of all fingerprints.

    A key holds the number of a segment, the segment, and the index of a
    codeword near the next segment. Fingerprints that differ in two bits or
    fewer agree in a segment and have a common codeword near the next one:
    within three bits of any word halfway lies a codeword.
    """
    parts = [((fingerprints >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
             for low, size in SEGMENTS]
    at, keys = [], []
    for i, whole in enumerate(parts):
        index, n = near_codewords(parts[(i + 1) % len(parts)])
        row, column = np.nonzero(np.arange(index.shape[1]) < n[:, None])
        at.append(row)
        keys.append((((np.int64(i) << 22) | whole[row]) << MESSAGE) | index[row, column])
    return np.concatenate(at), np.concatenate(keys)


def fingerprints(w: Words, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included; 0 without words."""
    data = _LOWER[w.data]
    # All words joined by single spaces.
    lengths = w.ends - w.starts + 1
    starts = np.cumsum(lengths) - lengths
    out = np.full(int(lengths.sum()), 0x20, np.uint8)
    spot = np.arange(len(out)) - np.repeat(starts, lengths)
    inside = spot < np.repeat(lengths - 1, lengths)
    out[inside] = data[(np.repeat(w.starts, lengths) + spot)[inside]]
    joined, ends = memoryview(out.tobytes()), starts + lengths - 1

    counts = w.counts
    full = np.flatnonzero(w.doc[:max(len(w.doc) - shingle + 1, 0)] == w.doc[shingle - 1:])
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    first = np.concatenate((full, w.first[short]))
    last = np.concatenate((full + shingle - 1, w.first[short + 1] - 1))
    doc = np.concatenate((w.doc[full], short))
    order = np.argsort(doc, kind="stable")
    first, last, doc = first[order], last[order], doc[order]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())),
                    np.uint64, len(first))
    sizes = np.bincount(doc, minlength=w.n_docs)
    ones = np.zeros((w.n_docs, 64), np.int64)
    for lo in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[lo:lo + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        owner = doc[lo:lo + BLOCK]
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        ones[owner[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    majority = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           seed: int = SEED) -> DataFrame:
    """Id and fingerprint (``node``, as signed bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                made = fingerprints(split_words(part.column(text_col)), shingle, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(made.view(np.int64))], ["id", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, node bigint")


def _close(members: list[np.ndarray], most: int) -> tuple[list[int], list[int]]:
    """Links that join what pairs of at most ``most`` differing bits join in each bucket."""
    a, b = [], []
    for group in members:
        x = np.sort(group.view(np.uint64))
        root = np.arange(len(x))
        for i in range(len(x) - 1):
            near = i + 1 + np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= most)
            for j in near.tolist():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(int(x[i].view(np.int64)))
                    b.append(int(x[j].view(np.int64)))
    return a, b


def fuzzy_links(nodes: DataFrame, most: int = MOST_BITS, full: int = FULL) -> DataFrame:
    """Verified links (a, b) that join all fingerprints (``node``, distinct) of few differing bits.

    Buckets of at most ``full`` members are compared pair by pair. Members of
    larger ones, as a family of thousands of near copies makes, meet a second
    time under every fingerprint within one bit of them: two that differ in at
    most two bits share one of those, and at most 65 share any. So work grows
    with the members of a bucket, not with its pairs, and no group is larger
    than ``full``.
    """
    if most > 2:
        raise ValueError("the keys find links of at most two differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node")
            at, keys = fuzzy_keys(np.asarray(node).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), node.take(pa.array(at))], ["key", "node"])

    keys = nodes.select("node").mapInArrow(spread, "key bigint, node bigint")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = stage(keys.join(stage(sizes, "golay-buckets").hint("merge"), "key"), "golay-keys")
    small = sized.where(F.col("n") <= full).groupBy("key").agg(F.collect_list("node").alias("nodes"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("nodes")
            flat, edge = np.asarray(lists.values), np.asarray(lists.offsets)
            a, b = _close([flat[x:y] for x, y in zip(edge[:-1], edge[1:])], most)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = small.select("nodes").mapInArrow(verify, "a bigint, b bigint")
    hot = sized.where(F.col("n") > full).select("node").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint")
                                              for i in range(64)])
    around = hot.select("node", F.explode(F.transform(flips, lambda bit: F.col("node").bitwiseXOR(bit))).alias("near"))
    met = around.groupBy("near").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    return links.unionByName(met.select("nodes").mapInArrow(verify, "a bigint, b bigint")).distinct()


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, most: int = MOST_BITS, full: int = FULL) -> DataFrame:
    """Per row: the id, its fingerprint in hexadecimal, component_id (smallest id reachable).

    Shingles are runs of ``shingle`` words, A-Z lower-cased, joined by one
    space, repeats included; of fewer words the whole sequence. Null and empty
    texts have fingerprint 0, which links like any other. Equal fingerprints,
    and those that differ in at most ``most`` bits, are linked. Rows that repeat
    an id get answers of their own; null ids never name a component that has
    another id. An empty table gives no rows; other columns are not looked at.
    """
    rows = stage(sketch(docs, id_col, text_col, shingle), "simhash")
    nodes = stage(rows.groupBy("node").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = connected(fuzzy_links(nodes, most, full))
    named = stage(nodes.join(roots.hint("merge"), "node", "left")
                  .withColumn("root", F.coalesce("root", "node")), "simhash-roots")
    classes = stage(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-classes")
    answers = stage(named.join(classes.hint("merge"), "root").select("node", "component_id"), "simhash-answers")
    return rows.join(answers.hint("merge"), "node").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
