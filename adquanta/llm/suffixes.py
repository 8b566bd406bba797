"""Substring duplicates by sparse suffix arrays.

Only suffixes at minimiser positions are kept. They are sorted by the words
that follow; neighbours that share enough of them form blocks, and within a
block the words before decide how far a match extends to the left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import SHARD_BYTES, VARIED, cut_repeats
from .rules import repeated
from .words import Words, mix

WINDOW = 50
MINIMISER = 12


def _around(w: Words, hashes: np.ndarray, at: np.ndarray, step: int, n: int) -> np.ndarray:
    """Hashes of ``n`` words from each position in the direction of ``step``; 0 outside the text."""
    spots = at[:, None] + step * np.arange(n)
    doc = w.doc[at][:, None]
    inside = (spots >= w.first[doc]) & (spots < w.first[doc + 1])
    return np.where(inside, hashes[np.where(inside, spots, 0)], np.uint64(0))


def find_with_suffixes(w: Words, hashes: np.ndarray, at: np.ndarray, copies: np.ndarray,
                       window: int) -> np.ndarray:
    """Which windows of the pieces repeat; all windows of a piece with copies do."""
    mask = np.zeros(len(hashes), bool)
    if not len(at):
        return mask
    left_most = at - w.first[:-1]
    windows = w.counts - window + 1
    right = _around(w, hashes, at, 1, window)
    order = np.argsort(np.ascontiguousarray(right.astype(">u8")).view(f"S{8 * window}").ravel())
    right = right[order]
    same = right[1:] == right[:-1]
    common = np.where(same.all(1), window, same.argmin(1))   # with the next suffix above
    at, left_most, windows, copies = at[order], left_most[order], windows[order], copies[order]
    block_of = np.zeros(len(at), np.int64)
    left = np.zeros(len(at), np.uint64)
    for back in range(int(left_most.max()) + 1):
        # Windows that start ``back`` words before their suffix.
        if back:
            spot = at - back
            inside = left_most >= back
            word = np.where(inside, hashes[np.where(inside, spot, 0)], np.uint64(0))
            left = mix(left + word)
        has = (left_most >= back) & (left_most - back < windows)
        if not has.any():
            continue
        block_of[1:] = np.cumsum(common < window - back)
        rows = np.flatnonzero(has)
        twice = repeated(mix(left[rows] ^ mix(block_of[rows].astype(np.uint64) + np.uint64(1))))
        mask[at[rows] - back] |= twice | (copies[rows] > 1)
    return mask


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER,
                   id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                   many: int = VARIED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove words in runs of ``window`` words that occur twice or more; see :func:`cut_repeats`."""
    return cut_repeats(docs, window, k, find_with_suffixes, id_col, text_col, digest, many, shard_bytes)
