"""Gradient-boosted trees on a bounded sample (logistic loss, histogram
splits, monotonic constraints), flattened into node arrays.

Every tree is a complete binary tree of ``depth`` levels stored level by
level: node ``i`` sends a row to ``2 i + 1`` or, when its feature is above the
threshold, to ``2 i + 2``. A node that was not split has threshold +inf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray    # (trees, 2**depth - 1)
    threshold: np.ndarray  # (trees, 2**depth - 1)
    leaf: np.ndarray       # (trees, 2**depth)
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def constant(value: float, depth: int = 3) -> Trees:
    n = 2**depth - 1
    return Trees(np.zeros((0, n), np.int64), np.zeros((0, n)), np.zeros((0, n + 1)), value)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 3, bins: int = 32, rate: float = 0.2,
        l2: float = 2.0, least: float = 5.0, monotone: dict[int, int] | None = None) -> Trees:
    """``monotone`` maps a feature to +1 (the score never falls as it rises)
    or -1. Splits that break it are refused, and the halves keep to either
    side of the split's mid value, so that deeper splits cannot break it."""
    if len(y) == 0 or y.min() == y.max():
        return constant(0.0 if len(y) == 0 else (6.0 if y.max() else -6.0), depth)
    monotone = monotone or {}
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        value = np.zeros(2 * inner + 1)
        node = np.zeros(n, np.int64)
        value[0] = -g.sum() / (h.sum() + l2)
        for level in range(depth):
            first = 2**level - 1
            width = 2**level
            local = node - first
            best = [(1e-6, -1, 0, 0.0, 0.0)] * width
            for j in range(d):
                b = len(edges[j]) + 1
                if b == 1:
                    continue
                key = local * b + codes[:, j]
                gs = np.bincount(key, weights=g, minlength=width * b).reshape(width, b).cumsum(1)
                hs = np.bincount(key, weights=h, minlength=width * b).reshape(width, b).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl, gr, hr = gs[:, :-1], hs[:, :-1], gt - gs[:, :-1], ht - hs[:, :-1]
                lo, hi = low[first: first + width, None], high[first: first + width, None]
                wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
                bad = (hl * 4 < least) | (hr * 4 < least)
                if j in monotone:
                    bad |= monotone[j] * (wr - wl) < 0
                gain = np.where(bad, -np.inf, gain)
                at = gain.argmax(1)
                for k in range(width):
                    if gain[k, at[k]] > best[k][0]:
                        best[k] = (gain[k, at[k]], j, at[k], wl[k, at[k]], wr[k, at[k]])
            go_right = np.zeros(n, bool)
            for k, (_, j, cut, wl, wr) in enumerate(best):
                i = first + k
                left, right = 2 * i + 1, 2 * i + 2
                low[[left, right]], high[[left, right]] = low[i], high[i]
                value[[left, right]] = value[i]
                if j < 0:
                    continue
                feature[i], threshold[i] = j, edges[j][cut]
                value[left], value[right] = wl, wr
                if j in monotone:
                    mid = (wl + wr) / 2
                    if monotone[j] > 0:
                        high[left], low[right] = min(high[left], mid), max(low[right], mid)
                    else:
                        low[left], high[right] = max(low[left], mid), min(high[right], mid)
                mine = local == k
                go_right |= mine & (codes[:, j] > cut)
            node = 2 * node + 1 + go_right
        leaf = np.clip(value[inner:], low[inner:], high[inner:]) * rate
        margin = margin + leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
