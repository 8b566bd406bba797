"""Packing of documents into token sequences along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .tokens import VOCABULARY, Encoder
from .words import chunks, mix

LENGTH = 1_024
DIMENSIONS, BITS = 4, 15
END = 0  # id that ends every document


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points (rows) with coordinates of ``bits`` bits.

    Gray-code form of the curve: coordinates are untangled from the highest bit
    down, then their bits are interleaved.
    """
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] >> level) & 1, turn ^ ((np.int64(1) << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


class Projection:
    """Mean hashed sign of a document's ids in a few dimensions, as grid points."""

    def __init__(self, n_ids: int):
        bits = mix(np.arange(n_ids, dtype=np.uint64) + np.uint64(1))
        # The signs of an id as ones and zeros, in fields that one sum counts together.
        self.fields = np.uint64(64 // DIMENSIONS) * np.arange(DIMENSIONS, dtype=np.uint64)
        self.most = (1 << 64 // DIMENSIONS) - 1  # ids whose sum leaves every field in its place
        signs = (bits[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)
        self.signs = (signs << self.fields).sum(1, dtype=np.uint64)

    def point(self, ids: np.ndarray) -> np.ndarray:
        positive = np.zeros(DIMENSIONS, dtype=np.int64)
        for i in range(0, len(ids), self.most):
            total = self.signs[ids[i:i + self.most]].sum(dtype=np.uint64)
            positive += ((total >> self.fields) & np.uint64(self.most)).astype(np.int64)
        mean = (2 * positive - len(ids)) / max(1, len(ids))
        return np.minimum(((mean + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: the id, its place on the curve, its ids as bytes (two or four an id)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        projection = Projection(encoder.size)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = encoder.encode(part.column("text").to_pylist())
                points = np.stack([projection.point(np.frombuffer(x, encoder.dtype)) for x in ids])
                width = pa.array(np.full(len(ids), encoder.dtype.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(hilbert_keys(points, BITS)), width,
                     pa.array(ids, pa.binary())], ["id", "curve", "width", "ids"])

    return docs.mapInArrow(run, f"id {kind}, curve bigint, width int, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences: id, start, length, doc_tokens, sequence_id, offset, ids.

    Every document is its ids and a closing 0; null is an empty text. Documents
    are range-sorted by their place on the curve (ties by id, so copies spread
    over ranges), and each range is one stream cut every ``length`` ids. All
    sequences are full but the last of a range. ``ids`` are little-endian
    unsigned 32-bit. Repeated rows are packed each; null ids come first; an
    empty table gives no rows. Tokens are written once to the shared folder, so
    sampling the ranges repeats no work.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tokens = stage(tokenised(plain, vocabulary), "tokens", compression="zstd")
    ordered = tokens.repartitionByRange("curve", "id").sortWithinPartitions("curve", "id")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_sequence = TaskContext.get().partitionId() << 40
        at = 0  # ids already placed in this range
        for batch in batches:
            rows: list[list] = [[] for _ in names[1:]]
            owner = []
            for i in range(batch.num_rows):
                kind = "<u2" if batch.column("width")[i].as_py() == 2 else "<u4"
                ids = np.frombuffer(batch.column("ids")[i].as_py(), kind).astype("<u4")
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                cuts = [0, *range(length - at % length, len(ids), length), len(ids)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    owner.append(i)
                    piece = (lo, hi - lo, len(ids), first_sequence + at // length, at % length,
                             ids[lo:hi].tobytes())
                    for column, value in zip(rows, piece):
                        column.append(value)
                    at += hi - lo
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner, pa.int64())),
                 *(pa.array(c, pa.int64()) for c in rows[:-1]), pa.array(rows[-1], pa.binary())], names)

    packed = ordered.mapInArrow(
        run, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
             "offset bigint, ids binary")
    return packed.withColumnRenamed("id", id_col)
