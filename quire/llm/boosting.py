"""Gradient-boosted trees for small tables of features (logistic loss)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth over quantile bins; deterministic for the same rows."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        if len(y) == 0 or y.min() == y.max():
            self.base = 4.0 if len(y) and y[0] else -4.0
            return self
        grid = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(g, c, side="left") for g, c in zip(grid, x.T)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            tree = self._grow(code, grid, grad, hess, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, code, grid, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = self.rate * g / (h + 1.0)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for j in range(code.shape[1]):
            k = len(grid[j]) + 1
            c = code[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(c, v, k))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        _, j, at = best
        if j is None:
            return leaf
        left = code[rows, j] <= at
        return (j, grid[j][at], self._grow(code, grid, grad, hess, rows[left], depth - 1), self._grow(code, grid, grad, hess, rows[~left], depth - 1))

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        left = x[:, j] <= cut
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        s = np.full(len(x), self.base)
        for tree in self.trees:
            s += self._walk(tree, x)
        return 1 / (1 + np.exp(-s))
