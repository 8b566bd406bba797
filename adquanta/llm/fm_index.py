"""Substring duplicates by backward search in FM-indexes over wavelet matrices.

Each shard indexes the symbols (one byte of a word's hash) of its pieces. All
windows walk backwards through the index together; the number of steps a window
makes before fewer than two suffixes are left is its matching statistic, and
windows whose statistic reaches the window length repeat. As different words
may share a symbol, the windows found are confirmed on 64-bit window hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import SHARD_BYTES, VARIED, cut_repeats
from .rules import repeated
from .words import Words

WINDOW = 35
MINIMISER = 8


class WaveletMatrix:
    """Rank queries on a byte sequence, in one packed bit row a level."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.rows, self.blocks, self.zeros = [], [], []
        start = np.zeros(256, np.int64)
        left = symbols
        for level in range(7, -1, -1):
            bit = (left >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[:len(bits)] = bits
            row = packed.view(np.uint64)
            self.rows.append(row)
            count = np.cumsum(np.bitwise_count(row), dtype=np.int64)
            self.blocks.append(np.concatenate(([0], count[:-1])))
            self.zeros.append(n - int(count[-1]))
            left = np.concatenate((left[bit == 0], left[bit == 1]))
        self.start = start
        self.start = self._walk(np.arange(256, dtype=np.uint8), np.zeros(256, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, row, block, zeros in zip(range(7, -1, -1), self.rows, self.blocks, self.zeros):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = block[word] + np.bitwise_count(row[word] & below)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, at) - self.start[symbol]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` or more bytes."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(8, np.uint8)))
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | padded[i:n + i].astype(np.uint64)
    span = 8
    while True:
        order = np.argsort(rank)
        sorted_rank = rank[order]
        step = np.zeros(n, np.int64)
        step[1:] = sorted_rank[1:] != sorted_rank[:-1]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(step) + 1
        if span >= depth or n == 0 or dense[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[:-span] = dense[span:]
        rank = (dense * (n + 1) + after).astype(np.uint64)
        span *= 2


class FMIndex:
    """Counts of patterns of at most ``depth`` symbols in a byte sequence."""

    def __init__(self, symbols: np.ndarray, depth: int):
        order = suffix_order(symbols, depth)
        self.n = len(symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=256))[:-1]))
        self.last = WaveletMatrix(symbols[order - 1])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with ``symbol`` put in front."""
        base = self.before[symbol]
        return base + self.last.rank(symbol, lo), base + self.last.rank(symbol, hi)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
        """For each end position the longest run ending before it that occurs twice, up to ``most``."""
        out = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        for length in range(1, most + 1):
            lo, hi = self.step(text[ends[alive] - length], lo, hi)
            more = hi - lo >= 2
            alive, lo, hi = alive[more], lo[more], hi[more]
            out[alive] = length
            if not len(alive):
                break
        return out


def find_with_index(w: Words, hashes: np.ndarray, at: np.ndarray, copies: np.ndarray,
                    window: int) -> np.ndarray:
    """Which windows of the pieces repeat; all windows of a piece with copies do."""
    mask = np.zeros(len(hashes), bool)
    start, key = w.windows(hashes, window)
    if not len(start):
        return mask
    sure = copies[w.doc[start]] > 1
    mask[start[sure]] = True
    # Pieces are separated by a zero byte; words have symbols 1 to 255.
    place = np.arange(len(hashes)) + w.doc
    symbols = np.zeros(len(hashes) + w.n_docs, np.uint8)
    symbols[place] = (hashes >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    index = FMIndex(symbols, window)
    asked = np.flatnonzero(~sure)
    reach = index.matching_statistics(symbols, place[start[asked]] + window, window)
    found = asked[reach >= window]
    exact = np.concatenate((found, np.flatnonzero(sure)))
    mask[start[found]] = repeated(key[exact])[:len(found)]
    return mask


def remove_substrings(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER,
                      id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                      many: int = VARIED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove words in windows that also start elsewhere; see :func:`cut_repeats`."""
    return cut_repeats(docs, window, k, find_with_index, id_col, text_col, digest, many, shard_bytes)
