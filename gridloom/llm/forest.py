"""A random forest of binary decision trees over a bounded training table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32  # cut points tried per feature


@dataclass
class Tree:
    """Nodes in a row: the feature asked, its cut, where to go, and the share of positives."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.share[at]
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.cut[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


class Forest:
    """Bagged trees that each choose among a random part of the features at every node."""

    def __init__(self, x, y, trees: int = 40, depth: int = 8, least: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees = []
        if len(y) and 0 < y.sum() < len(y):
            for _ in range(trees):
                rows = rng.integers(0, len(y), len(y))
                self.trees.append(_grow(x[rows], y[rows].astype(float), depth, least, rng))
        self.constant = float(y.mean()) if len(y) else 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        if not self.trees or not len(x):
            return np.full(len(x), self.constant)
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng) -> Tree:
    nodes: list[list] = []
    some = max(1, int(np.sqrt(x.shape[1]) + 0.5))

    def node(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if left_depth == 0 or len(rows) < 2 * least or nodes[me][4] in (0.0, 1.0):
            return me
        best = (1e-12, -1, 0.0)
        for f in rng.permutation(x.shape[1])[:some]:
            best = max(best, _split(x[rows, f], y[rows], int(f), least), key=lambda b: b[0])
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = node(rows[low], left_depth - 1)
            nodes[me][3] = node(rows[~low], left_depth - 1)
        return me

    node(np.arange(len(y)), depth)
    feature, cut, left, right, share = zip(*nodes)
    return Tree(*(np.array(c) for c in (feature, cut, left, right, share)))


def _split(values: np.ndarray, y: np.ndarray, feature: int, least: int) -> tuple[float, int, float]:
    """The cut with the largest drop in Gini impurity: (drop, feature, cut)."""
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 2)[1:-1], method="lower"))
    low = np.searchsorted(cuts, values, "left")
    many = np.cumsum(np.bincount(low, minlength=len(cuts) + 1))[:-1]
    good = np.cumsum(np.bincount(low, weights=y, minlength=len(cuts) + 1))[:-1]
    rest, rest_good = len(y) - many, y.sum() - good
    fits = (many >= least) & (rest >= least)
    if not fits.any():
        return (0.0, -1, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        drop = good * good / many + rest_good * rest_good / rest - y.sum() ** 2 / len(y)
    drop = np.where(fits, drop, -1.0)
    i = int(drop.argmax())
    return (float(drop[i]), feature, float(cuts[i]))
