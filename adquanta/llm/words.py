"""Words, hashes and windows of many texts at once, over flat NumPy arrays.

A word is a run of bytes other than space and \\x09-\\x0D. Texts stay the UTF-8
bytes that Arrow hands over; nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

# Bytes of text handled at once; one longer text is still handled whole.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        made = np.empty((2, n + n // 4), np.uint64)
        for row, factor in zip(made, (_BASE, _INVERSE)):
            row[:] = factor
            row[0] = 1
            np.cumprod(row, out=row)
        _powers = made
    return _powers[0, :n], _powers[1, :n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


@dataclass
class Words:
    """Flat words of a batch; word ``i`` is ``data[starts[i]:ends[i]]`` of text ``doc[i]``."""

    data: np.ndarray      # bytes of all texts
    bounds: np.ndarray    # text t is data[bounds[t]:bounds[t + 1]]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray     # words of text t are first[t]..first[t + 1] - 1
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z lower-cased on request)."""
        return self.prefix_hashes((None,), lower)[0]

    def prefix_hashes(self, sizes: tuple[int | None, ...], lower: bool = False) -> list[np.ndarray]:
        """Hashes of each word's first bytes, for several sizes (None: the whole word)."""
        data = _LOWER[self.data] if lower else self.data
        if not len(self.starts):
            return [np.zeros(0, np.uint64) for _ in sizes]
        up, down = powers(len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        ends = [self.ends if n is None else np.minimum(self.starts + n, self.ends) for n in sizes]
        return [mix((total[e] - total[self.starts]) * down[self.starts]) for e in ends]

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words of one text."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1:])
        up, down = powers(len(hashes) + 1)
        total = np.empty(len(hashes) + 1, np.uint64)
        total[0] = 0
        np.cumsum(hashes * up[:-1], out=total[1:])
        return at, mix((total[at + n] - total[at]) * down[at])


def split_words(texts: pa.Array, space: np.ndarray = _SPACE) -> Words:
    """The words of a string array; null has none. ``space`` flags the separating bytes."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:] \
        if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None \
        else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, bounds, starts, ends, first, doc)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each."""
    lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
    total, start = np.cumsum(lengths), 0
    while start < len(total):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def cover(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the half-open ranges."""
    step = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def kept_text(words: Words, doc: int, keep: np.ndarray) -> bytes:
    """Kept words of one text joined by single spaces; ``keep`` is over all words of the batch."""
    lo, hi = words.first[doc], words.first[doc + 1]
    chosen = np.flatnonzero(keep[lo:hi]) + lo
    data, starts, ends = words.data, words.starts[chosen], words.ends[chosen]
    if not len(chosen):
        return b""
    lengths = ends - starts + 1
    out = np.full(lengths.sum(), 0x20, np.uint8)
    offset = np.cumsum(lengths) - lengths
    spot = np.arange(len(out)) - np.repeat(offset, lengths)
    inside = spot < np.repeat(lengths - 1, lengths)
    out[inside] = data[(np.repeat(starts, lengths) + spot)[inside]]
    return out[:-1].tobytes()


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores put behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
