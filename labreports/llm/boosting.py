"""Small gradient-boosted trees for candidates that are described by a few dozen numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Additive log-odds of complete binary trees of one depth; node n has children 2n+1, 2n+2."""

    base: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray  # trees x inner nodes; larger values go right
    leaves: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def fit_boosted(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24
) -> Boosted:
    """Second-order boosting of the logistic loss on binned features."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    inner = (1 << depth) - 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    odds = np.full(len(y), base)
    features = np.zeros((trees, inner), np.int64)
    cuts = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            own = np.flatnonzero(node == n)
            best = 1e-6
            for k in range(width):
                if not len(edges[k]) or not len(own):
                    continue
                g = np.bincount(binned[own, k], slope[own], len(edges[k]) + 1)
                h = np.bincount(binned[own, k], curve[own], len(edges[k]) + 1)
                left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                right_g, right_h = g.sum() - left_g, h.sum() - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
                gain -= g.sum() ** 2 / (h.sum() + 1)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, features[tree, n], cuts[tree, n] = gain[at], k, edges[k][at]
            right = x[own, features[tree, n]] > cuts[tree, n]
            node[own] = 2 * n + 1 + right
        for leaf in range(inner + 1):
            own = node == inner + leaf
            leaves[tree, leaf] = -rate * slope[own].sum() / (curve[own].sum() + 1)
        odds += leaves[tree][node - inner]
    return Boosted(base, features, cuts, leaves)
