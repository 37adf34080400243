"""Gradient-boosted trees on binned features, and isotonic calibration; small fits on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Sum of trees of one depth, stored as arrays: a node's children are 2i+1 and 2i+2."""

    base: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature (-1: leaf), cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += self.rate * value[at]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, smooth: float = 1.0, least: float = 1.0) -> Boosted:
    """Logistic loss, second-order splits; constant for one class or no rows."""
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    model = Boosted(float(np.log(share / (1 - share))), rate)
    if len(y) == 0 or y.min() == y.max():
        return model
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, model.base)
    size = 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(n, np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = gs / (hs + smooth)
            if node >= size // 2 or hs < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for j in range(m):
                if len(edges[j]) == 0:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], BINS + 1))[: len(edges[j])]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], BINS + 1))[: len(edges[j])]
                gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        score += rate * value[at]
        model.trees.append((feature, cut, value))
    return model


@dataclass
class Isotonic:
    """Nondecreasing steps, linear between their centres; a sliver of the uncalibrated score keeps the ranking."""

    knots: np.ndarray
    values: np.ndarray
    sliver: float = 0.001

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        plain = sigmoid(raw)
        level = np.interp(raw, self.knots, self.values) if len(self.knots) else plain
        return np.clip((1 - self.sliver) * level + self.sliver * plain, 0.0, 1.0)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal scores are one point."""
    points, inverse = np.unique(raw, return_inverse=True)
    weight = np.bincount(inverse, minlength=len(points)).astype(float)
    mean = np.bincount(inverse, y, len(points)) / np.maximum(weight, 1)
    pools: list[list[float]] = []  # weight, mean, sum of weighted scores
    for p, w, v in zip(points, weight, mean):
        pools.append([w, v, p * w])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, v2, p2 = pools.pop()
            w1, v1, p1 = pools[-1]
            pools[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), p1 + p2]
    return Isotonic(np.array([p / w for w, _, p in pools]), np.array([v for _, v, _ in pools]))
