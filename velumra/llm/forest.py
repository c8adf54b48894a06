"""A random forest of binary trees over a small matrix, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees side by side: at a node, rows of ``x[:, feature] <= cut`` go to
    ``left``, others to ``left + 1``; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves that each row falls in."""
        if not len(x):
            return np.empty(0)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, share in zip(self.feature, self.cut, self.left, self.share):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = left[at] >= 0
                at = np.where(inner, left[at] + (x[rows, feature[at]] > cut[at]), at)
            total += share[at]
        return total / len(self.feature)


def _tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> tuple[list, list, list, list]:
    feature, cut, left, share = [0], [0.0], [-1], [0.0]
    todo = [(0, np.arange(len(y)), 0)]
    tries = max(1, int(np.sqrt(x.shape[1])))
    while todo:
        node, rows, level = todo.pop()
        share[node] = float(y[rows].mean())
        if level == depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
            continue
        best = (1e-9, 0, 0.0)
        for f in rng.permutation(x.shape[1])[: tries * 2]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, s = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            p, q = s[:-1] / n, (s[-1] - s[:-1]) / (len(order) - n)
            gain = share[node] * (1 - share[node]) * len(order) - n * p * (1 - p) - (len(order) - n) * q * (1 - q)
            gain[(v[1:] == v[:-1]) | (n < least) | (len(order) - n < least)] = -1
            if len(gain) and gain[k := int(gain.argmax())] > best[0]:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[0] <= 1e-9:
            continue
        feature[node], cut[node], left[node] = best[1], best[2], len(feature)
        side = x[rows, best[1]] > best[2]
        for part in (rows[~side], rows[side]):
            todo.append((len(feature), part, level + 1))
            feature.append(0)
            cut.append(0.0)
            left.append(-1)
            share.append(0.0)
    return feature, cut, left, share


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 2, seed: int = 11) -> Forest:
    """Each tree sees a bootstrap of the rows and, at each split, a random part
    of the features; splits minimise Gini impurity."""
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_tree(x[rows], y[rows].astype(float), depth, least, rng))
    size = max(len(t[0]) for t in grown)
    pad = lambda k, fill: np.array([t[k] + [fill] * (size - len(t[k])) for t in grown])
    return Forest(pad(0, 0), pad(1, 0.0), pad(2, -1), pad(3, 0.0), depth)
