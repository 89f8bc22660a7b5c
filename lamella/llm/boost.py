"""Gradient-boosted trees in NumPy: logistic loss, histogram splits, scoring by arrays. Small enough to travel in a closure."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier; ``fit`` is deterministic."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, damp: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.damp = rounds, depth, rate, bins, damp

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if n else 0.5
        self.base, size = float(np.log(share / (1 - share))), (2 << self.depth) - 1
        score = np.full(n, self.base)
        self.feature = np.zeros((self.rounds, size), dtype=np.int64)
        self.cut = np.full((self.rounds, size), np.inf)
        self.value = np.zeros((self.rounds, size))
        width = self.bins + 1
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (2 << level) - 1):
                    rows = np.nonzero(node == k)[0]
                    if len(rows) < 8:
                        continue
                    flat = (code[rows] + np.arange(d) * width).ravel()
                    gs = np.bincount(flat, np.repeat(g[rows], d), d * width).reshape(d, width).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(h[rows], d), d * width).reshape(d, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.damp) + (gt - gs) ** 2 / (ht - hs + self.damp) - gt**2 / (ht + self.damp)
                    gain[:, -1] = 0
                    j, b = divmod(int(gain.argmax()), width)
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        self.feature[r, k], self.cut[r, k] = j, cuts[j][b]
                right = x[np.arange(n), self.feature[r, node]] > self.cut[r, node]
                node = 2 * node + 1 + right
            gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
            self.value[r] = self.rate * gs / (hs + self.damp)
            score = score + self.value[r, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, at = np.full(len(x), self.base), np.arange(len(x))
        for r in range(self.rounds):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, self.feature[r, node]] > self.cut[r, node])
            score += self.value[r, node]
        return 1 / (1 + np.exp(-score))


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration on held-out rows: scores and the rising share of positives at them (pool adjacent violators, with one
    positive and one negative added to each pool), for np.interp."""
    order = np.argsort(p, kind="stable")
    pools: list[list[float]] = []  # hits, rows, sum of scores
    for score, hit in zip(p[order].tolist(), y[order].tolist()):
        pools.append([hit, 1.0, score])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    share = np.maximum.accumulate([(h + 1) / (n + 2) for h, n, _ in pools]) if pools else np.array([0.0, 1.0])
    return (np.array([s / n for _, n, s in pools]) if pools else np.array([0.0, 1.0])), share


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the highest F1 on held-out rows: the middle of the widest gap of scores that reaches it."""
    best, at = -1.0, 0.5
    for t in np.linspace(0.05, 0.95, 91):
        hit = int(((p >= t) & (y == 1)).sum())
        f = 2 * hit / max(1, int((p >= t).sum()) + int((y == 1).sum()))
        if f > best + 1e-12 or (abs(f - best) <= 1e-12 and abs(t - 0.5) < abs(at - 0.5)):
            best, at = f, float(t)
    return at
