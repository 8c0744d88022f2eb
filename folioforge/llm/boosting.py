"""Gradient-boosted trees for two classes, small enough to ship with a task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of limited depth on the logistic loss, with binned split search."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        cells = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(x), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, cells, cuts, y - prob, prob * (1 - prob), np.arange(len(x)), 0)
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    def _grow(self, tree: list, cells: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int) -> int:
        """Adds the node for the rows ``at`` and returns its place. A node is (feature,
        threshold, left, right), a leaf (-1, value, 0, 0)."""
        place = len(tree)
        tree.append(None)
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-6, None)
        if depth < self.depth and len(at) >= 2 * self.least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = cells[at, f]
                gs, hs, ns = (np.bincount(k, w, len(c) + 1)[:-1].cumsum() for w in (g[at], h[at], np.ones(len(at))))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (f, i))
        if best[1] is None:
            tree[place] = (-1, self.rate * total_g / (total_h + 1), 0, 0)
            return place
        f, i = best[1]
        left = cells[at, f] <= i
        a = self._grow(tree, cells, cuts, g, h, at[left], depth + 1)
        b = self._grow(tree, cells, cuts, g, h, at[~left], depth + 1)
        tree[place] = (f, float(cuts[f][i]), a, b)
        return place

    @staticmethod
    def _tree(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        feature, value, left, right = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        for _ in range(len(tree)):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes = x[np.arange(len(x)), np.maximum(f, 0)] <= value[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        x = np.asarray(x, float)
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.base + sum(self._tree(t, x) for t in self.trees))))
