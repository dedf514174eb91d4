"""Gradient-boosted trees for binary labels, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: (feature, threshold) of each inner node in level order, and the leaves' values."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Trees with log loss. Bins are quantiles; a split needs ``least`` of hessian on both sides."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    # columns of two values are added up together, by the rows that have the upper one
    flags = np.array([j for j in range(d) if len(cuts[j]) == 1], np.int64)
    many = [j for j in range(d) if len(cuts[j]) > 1]
    row, flag = np.nonzero(binned[:, flags])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            if len(flags):
                add = lambda w: np.bincount(local[row] * len(flags) + flag, w[row], width * len(flags)).reshape(width, -1)
                g1, h1 = add(g), add(h)
                gt, ht = np.bincount(local, g, width)[:, None], np.bincount(local, h, width)[:, None]
                gain = g1**2 / (h1 + l2) + (gt - g1) ** 2 / (ht - h1 + l2) - gt**2 / (ht + l2)
                gain[(h1 < least) | (ht - h1 < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best):
                    j = flags[k[node]]
                    best[node], feature[first + node], limit[first + node] = top[node], j, cuts[j][0]
            for j in many:
                size = len(cuts[j]) + 1
                key = local * size + binned[:, j]
                gs = np.bincount(key, g, width * size).reshape(width, size).cumsum(1)
                hs = np.bincount(key, h, width * size).reshape(width, size).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                k = gain[:, :-1].argmax(1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best):
                    best[node], feature[first + node], limit[first + node] = top[node], j, cuts[j][k[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        model.features.append(feature)
        model.limits.append(limit)
        model.leaves.append(value)
    return model
