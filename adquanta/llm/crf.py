"""Linear-chain conditional random field with two tags, on flat token arrays.

Chains are cut into blocks of equal length. The transfer matrices of all blocks
are multiplied at once, the blocks of a chain are then joined in order, and a
second sweep fills in every token: exact marginals without a loop over tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BLOCK = 64


class Chains:
    """Layout of flat tokens as columns of blocks; ``first`` bounds the chains."""

    def __init__(self, first: np.ndarray):
        counts = np.diff(first)
        n_blocks = -(-counts // BLOCK)
        self.first_block = np.concatenate(([0], np.cumsum(n_blocks)))
        self.n = int(self.first_block[-1])
        self.n_blocks = n_blocks
        token = np.arange(first[-1])
        chain = np.repeat(np.arange(len(counts)), counts)
        within = token - first[chain]
        self.row = within % BLOCK
        self.column = self.first_block[chain] + within // BLOCK
        self.head = token[within == 0]
        self.tail = within == counts[chain] - 1

    def grid(self, flat: np.ndarray, fill: float) -> np.ndarray:
        out = np.full((BLOCK, self.n), fill, flat.dtype)
        out[self.row, self.column] = flat
        return out

    def flat(self, grid: np.ndarray) -> np.ndarray:
        return grid[self.row, self.column]


@dataclass
class Chain:
    """Weights: a bias and one weight a feature for tag 1, transitions, start."""

    weights: np.ndarray                       # the last entry is the absent feature, always 0
    bias: float = 0.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[features].sum(0)

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per token: the chance of tag 1, and forward and backward vectors (scaled)."""
        c = Chains(first)
        x = np.exp(np.clip(self.emissions(features), -30, 30))
        (a, b), (p, q) = np.exp(self.transition)
        # Step matrices [[m00, m01], [m10, m11]]; past a chain's end the identity.
        m00, m01 = np.full(len(x), a), b * x
        m10, m11 = np.full(len(x), p), q * x
        begin = np.exp(self.start)
        m00[c.head] = m10[c.head] = 1.0
        m01[c.head] = m11[c.head] = begin * x[c.head]
        m00, m11 = c.grid(m00, 1.0), c.grid(m11, 1.0)
        m01, m10 = c.grid(m01, 0.0), c.grid(m10, 0.0)
        # Products of whole blocks.
        t00, t11 = np.ones(c.n), np.ones(c.n)
        t01, t10 = np.zeros(c.n), np.zeros(c.n)
        for i in range(BLOCK):
            t00, t01 = t00 * m00[i] + t01 * m10[i], t00 * m01[i] + t01 * m11[i]
            t10, t11 = t10 * m00[i] + t11 * m10[i], t10 * m01[i] + t11 * m11[i]
            scale = t00 + t01 + t10 + t11
            t00, t01, t10, t11 = t00 / scale, t01 / scale, t10 / scale, t11 / scale
        # Joined in order: vectors before and after each block.
        into, after = np.ones((2, c.n)), np.ones((2, c.n))
        into[1] = 0.0
        most = int(c.n_blocks.max(initial=0))
        for k in range(1, most):
            at = c.first_block[:-1][c.n_blocks > k] + k
            u, v = into[:, at - 1]
            new = np.stack((u * t00[at - 1] + v * t10[at - 1], u * t01[at - 1] + v * t11[at - 1]))
            into[:, at] = new / new.sum(0)
        for k in range(1, most):
            at = c.first_block[1:][c.n_blocks > k] - 1 - k
            u, v = after[:, at + 1]
            new = np.stack((t00[at + 1] * u + t01[at + 1] * v, t10[at + 1] * u + t11[at + 1] * v))
            after[:, at] = new / new.sum(0)
        # Every token.
        forward, backward = np.empty((2, BLOCK, c.n)), np.empty((2, BLOCK, c.n))
        u, v = into
        for i in range(BLOCK):
            u, v = u * m00[i] + v * m10[i], u * m01[i] + v * m11[i]
            scale = u + v
            u, v = u / scale, v / scale
            forward[0, i], forward[1, i] = u, v
        u, v = after
        for i in range(BLOCK - 1, -1, -1):
            backward[0, i], backward[1, i] = u, v
            u, v = m00[i] * u + m01[i] * v, m10[i] * u + m11[i] * v
            scale = u + v
            u, v = u / scale, v / scale
        f = np.stack((c.flat(forward[0]), c.flat(forward[1])))
        g = np.stack((c.flat(backward[0]), c.flat(backward[1])))
        one = f[1] * g[1]
        return one / (one + f[0] * g[0]), f, g

    def fit(self, features: np.ndarray, first: np.ndarray, tags: np.ndarray,
            ridge: float = 1.0, steps: int = 60, rate: float = 0.15) -> Chain:
        """Maximise the penalised likelihood of the tags by Adam steps."""
        n = len(tags)
        starts = np.zeros(n, bool)
        starts[first[:-1][np.diff(first) > 0]] = True
        inner = np.flatnonzero(~starts)
        size = len(self.weights)
        theta = np.zeros(size + 6)
        theta[size] = np.log((tags.sum() + 1) / (n - tags.sum() + 1))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        np.add.at(seen, (tags[inner - 1], tags[inner]), 1)
        for step in range(1, steps + 1):
            self._set(theta, size)
            p, f, g = self.marginals(features, first)
            slope = np.zeros_like(theta)
            miss = p - tags
            for row in features:
                slope[:size] += np.bincount(row, miss, size)
            slope[size - 1] = 0
            slope[size] = miss.sum()
            x = np.exp(np.clip(self.emissions(features), -30, 30))
            pair = np.empty((2, 2, len(inner)))
            for a in (0, 1):
                for b in (0, 1):
                    pair[a, b] = f[a, inner - 1] * np.exp(self.transition[a, b]) \
                        * (x[inner] if b else 1.0) * g[b, inner]
            pair /= pair.sum((0, 1))
            slope[size + 1:size + 5] = (pair.sum(2) - seen).ravel()
            slope[size + 5] = miss[starts].sum()
            slope = (slope + ridge * np.r_[theta[:size], np.zeros(1), theta[size + 1:]]) / n
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self._set(theta, size)
        return self

    def _set(self, theta: np.ndarray, size: int) -> None:
        self.weights = theta[:size].copy()
        self.weights[-1] = 0.0
        self.bias, self.start = float(theta[size]), float(theta[size + 5])
        self.transition = theta[size + 1:size + 5].reshape(2, 2).copy()
