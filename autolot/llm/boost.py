"""Gradient boosted trees for a yes/no label, on a bounded numpy sample (logistic loss, Newton leaves)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of `depth` levels; a node sends a row right if its feature exceeds the bound."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.size, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(p / (1 - p)))
        bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
        cell = np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds)], 1)
        score = np.full(len(y), self.start)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, bound = np.zeros(2**self.depth, int), np.full(2**self.depth, np.inf)
            node = np.ones(len(y), int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    own = np.flatnonzero(node == k)
                    best = 1e-6
                    for f, b in enumerate(bounds):
                        if not len(b) or not len(own):
                            continue
                        gs, hs = (np.cumsum(np.bincount(cell[own, f], w[own], len(b) + 1)) for w in (g, h))
                        gain = gs[:-1] ** 2 / (hs[:-1] + self.ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.ridge) - gs[-1] ** 2 / (hs[-1] + self.ridge)
                        if gain.max() > best:
                            best, feature[k], bound[k] = gain.max(), f, b[gain.argmax()]
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > bound[node])
            node -= 2**self.depth
            leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge)
            score += leaf[node]
            self.trees.append((feature, bound, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, bound, leaf in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] > bound[node])
            score += leaf[node - 2**self.depth]
        return 1 / (1 + np.exp(-score))
