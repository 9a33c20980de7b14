"""Gradient-boosted symmetric trees in numpy: one split per level, so that scoring is a table lookup."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class SymmetricBoost:
    """Binary classifier with logistic loss. ``fit`` bins features by quantiles; null features count as -1."""

    trees: int = 40
    depth: int = 4
    rate: float = 0.3
    bins: int = 24
    l2: float = 2.0
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    cut: float = 0.5
    splits: list[tuple[list[int], list[float], np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> SymmetricBoost:
        n, k = x.shape
        if not n:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf, chosen, cuts = np.zeros(n, np.int64), [], []
            for level in range(self.depth):
                best = (-1.0, 0, 0)
                size = 1 << level
                for j in range(k):
                    b = len(edges[j]) + 1
                    if b == 1:
                        continue
                    at = leaf * b + codes[:, j]
                    gs = np.bincount(at, g, size * b).reshape(size, b).cumsum(1)
                    hs = np.bincount(at, h, size * b).reshape(size, b).cumsum(1)
                    left = gs[:, :-1] ** 2 / (hs[:, :-1] + self.l2)
                    right = (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + self.l2)
                    gain = (left + right).sum(0)
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), j, c)
                _, j, c = best
                chosen.append(j)
                cuts.append(float(edges[j][c]) if len(edges[j]) else np.inf)
                leaf = leaf * 2 + (codes[:, j] > c)
            gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            values = self.rate * gs / (hs + self.l2)
            score = score + values[leaf]
            self.splits.append((chosen, cuts, values))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for chosen, cuts, values in self.splits:
            leaf = np.zeros(len(x), np.int64)
            for j, c in zip(chosen, cuts):
                leaf = leaf * 2 + (x[:, j] > c)
            score += values[leaf]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> SymmetricBoost:
        """Platt scaling on held-out rows, and the threshold of the calibrated score with the best F1 there."""
        if not len(x) or y.min() == y.max():
            return self
        s = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * s + b)))
            a += 0.5 * float(((y - p) * s).mean() / (s.var() + 1))
            b += 0.5 * float((y - p).mean())
        self.scale, self.shift = a, b
        p = self.predict(x)
        grid = np.linspace(0.1, 0.9, 33)
        f1 = [2 * (y * (p >= t)).sum() / (y.sum() + (p >= t).sum() + 1e-9) for t in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        self.cut = float(grid[best[len(best) // 2]])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -50, 50)))
