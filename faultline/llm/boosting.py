"""Small gradient-boosted trees on binned features, for models fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with complete binary trees of one depth.

    Fitted on the driver on a sample whose size the caller bounds; scoring is
    vectorised and runs inside tasks.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = x.astype(np.float64)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = self._bin(x)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(binned, tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)

    def _tree(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, int), np.full(inner, self.bins)
        node = np.zeros(len(grad), int)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = 1e-6
            if len(rows) > 10:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for f in range(binned.shape[1]):
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g, self.bins))
                    hl = np.cumsum(np.bincount(b, h, self.bins))
                    gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[i], cut[i] = gain[k], f, k
            node[rows] = 2 * i + 1 + (binned[rows, feature[i]] > cut[i])
        leaf = node - inner
        n = 1 << self.depth
        value = self.rate * np.bincount(leaf, grad, n) / (np.bincount(leaf, hess, n) + 1)
        return feature, cut, value

    def _walk(self, binned: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), int)
        every = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[every, feature[node]] > cut[node])
        return value[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        binned = self._bin(x.astype(np.float64))
        return 1 / (1 + np.exp(-(self.base + sum(self._walk(binned, t) for t in self.trees))))


class Calibration:
    """Scores to probabilities by isotonic regression: pooled steps that never fall, fitted on examples of their own."""

    def __init__(self, score: np.ndarray, y: np.ndarray) -> None:
        edges, counts = np.unique(score, return_inverse=True)
        hits, n = np.bincount(counts, y, len(edges)), np.bincount(counts, minlength=len(edges))
        pools: list[list[float]] = []  # lowest score, hits, examples
        for e, h, k in zip(edges.tolist(), hits.tolist(), n.tolist()):
            pools.append([e, h, k])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, h, k = pools.pop()
                pools[-1][1] += h
                pools[-1][2] += k
        self.start = np.array([x[0] for x in pools])
        self.value = np.array([x[1] / x[2] for x in pools])

    def probability(self, score: np.ndarray) -> np.ndarray:
        """The pool's share of hits; scores below all examples get the lowest one, and without examples all get 0."""
        if not len(self.start):
            return np.zeros(len(score))
        return self.value[np.maximum(np.searchsorted(self.start, score, side="right") - 1, 0)]
