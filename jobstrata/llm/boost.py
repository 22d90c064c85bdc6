"""Boosted regression trees for the logistic loss, fitted on a bounded sample in the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node k tests ``x[feature[k]] <= threshold[k]``: yes leads to ``left[k]``, no to ``right[k]``; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(64):
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                break
            at = node[inner]
            yes = x[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(yes, self.left[at], self.right[at])
        return self.value[node]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every node but the root as the conjunction of (feature, is at most, threshold) tests that leads to it."""
        found, open_ = [], [(0, ())]
        while open_:
            k, path = open_.pop()
            if path:
                found.append(path)
            if self.feature[k] >= 0:
                test = int(self.feature[k]), float(self.threshold[k])
                open_ += [(self.left[k], (*path, (test[0], True, test[1]))), (self.right[k], (*path, (test[0], False, test[1])))]
        return found


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds halfway between neighbouring quantiles."""
    at = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (at[1:] + at[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 10, bins: int = 64) -> tuple[float, list[Tree]]:
    """The start log-odds and the trees; ``y`` is 0 or 1. Ties go to the lower feature, then the lower cut."""
    n, width = x.shape
    cuts = [_cuts(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    share = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p) + 1e-9
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            g, h = slope[rows].sum(), bend[rows].sum()
            k = len(nodes)
            nodes.append([-1, 0.0, -1, -1, rate * g / (h + 1.0)])
            if level == depth or len(rows) < 2 * least:
                return k
            best = (1e-6, -1, -1)
            for f in range(width):
                m = len(cuts[f])
                if not m:
                    continue
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, m + 1))[:-1] for w in (slope[rows], bend[rows], None))
                gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), f, at)
            if best[1] < 0:
                return k
            yes = binned[rows, best[1]] <= best[2]
            nodes[k][0], nodes[k][1] = best[1], float(cuts[best[1]][best[2]])
            nodes[k][2] = grow(rows[yes], level + 1)
            nodes[k][3] = grow(rows[~yes], level + 1)
            return k

        grow(np.arange(n), 0)
        f, t, a, b, v = zip(*nodes)
        tree = Tree(np.array(f), np.array(t, float), np.array(a), np.array(b), np.array(v, float))
        score += tree.predict(x)
        grown.append(tree)
    return start, grown


def log_odds(start: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return start + sum((t.predict(x) for t in trees), np.zeros(len(x)))
