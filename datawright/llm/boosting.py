"""Gradient-boosted regression trees for a softmax over classes, in numpy: small, deterministic, trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: ``feature`` and ``cut`` (trees, inner nodes), ``value`` (trees, leaves); tree t votes for class t % classes."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    classes: int
    depth: int

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(x), self.classes))
        rows, flat, width = np.arange(len(x)) * x.shape[1], x.ravel(), 2**self.depth - 1
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[rows + self.feature[t][node]] > self.cut[t][node])
            score[:, t % self.classes] += self.value[t][node - width]
        top = score.max(axis=1, keepdims=True)
        return score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Newton boosting on quantile-binned features: each split takes the largest gain of its level's nodes."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    n, many = x.shape
    width = bins + 1
    offset = binned + np.arange(many) * width
    score = np.zeros((n, classes))
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(classes):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                first, wide = 2**level - 1, 2**level
                at = ((node - first) * (many * width))[:, None] + offset
                gs = np.bincount(at.ravel(), np.repeat(g, many), wide * many * width).reshape(wide, many, width).cumsum(axis=2)
                hs = np.bincount(at.ravel(), np.repeat(h, many), wide * many * width).reshape(wide, many, width).cumsum(axis=2)
                g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
                for w in range(wide):
                    f, b = divmod(int(gain[w].argmax()), width)
                    if gain[w, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[first + w], cut[first + w] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            score[:, k] += value[leaf]
            features.append(feature)
            thresholds.append(cut)
            values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), classes, depth)
