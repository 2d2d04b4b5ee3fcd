"""Gradient-boosted trees with monotonic constraints, trained and scored in numpy.

Trees are complete binary trees of a fixed depth in heap order, so a model is
three arrays: split feature and threshold for each inner node, value for each
leaf.  Scoring walks all rows of a block down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 5) -> Trees:
    """Logistic boosting on histogram bins.

    monotone: +1, -1 or 0 for each feature.  A split on a constrained feature
    must order its children's values, and its children's subtrees are clipped
    at the midpoint, so the sum of trees is monotone.  One class only: no trees,
    the score is that class's smoothed frequency.
    """
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate_1 / (1 - rate_1)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) < 2 * min_rows or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1)  # code <= b  <=>  x <= cuts[b]
    n_f = x.shape[1]
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_out, t_out, v_out = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            low[2 * at + 1 : 2 * at + 3], high[2 * at + 1 : 2 * at + 3] = low[at], high[at]
            best = None
            if len(rows) >= 2 * min_rows:
                flat = (codes[rows] + np.arange(n_f) * (bins + 1)).ravel()
                gs, hs, ns = (np.bincount(flat, np.repeat(w, n_f), n_f * (bins + 1)).reshape(n_f, -1).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows))))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                wl, wr = (np.clip(a / (b + l2), low[at], high[at]) for a, b in ((gl, hl), (gr, hr)))
                gain = sum(2 * a * w - (b + l2) * w * w for a, b, w in ((gl, hl, wl), (gr, hr, wr)))
                whole = np.clip(gs[:, -1:] / (hs[:, -1:] + l2), low[at], high[at])
                gain = gain - (2 * gs[:, -1:] * whole - (hs[:, -1:] + l2) * whole**2)
                gain[(nl < min_rows) | (nr < min_rows) | ((wr - wl) * monotone[:, None] < 0)] = -np.inf
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-6:
                    best = f, b, wl[f, b], wr[f, b]
            if best is None:
                node[rows] = 2 * at + 1  # threshold inf: all rows go left
                continue
            f, b, left, right = best
            f_out[at], t_out[at] = f, cuts[f][b]
            if monotone[f]:
                mid = (left + right) / 2
                bound = (high, low) if monotone[f] > 0 else (low, high)
                bound[0][2 * at + 1] = mid
                bound[1][2 * at + 2] = mid
            node[rows] = 2 * at + 1 + (codes[rows, f] > b)
        for k in range(leaves):
            rows = node == inner + k
            if rows.any():
                v_out[k] = rate * np.clip(g[rows].sum() / (h[rows].sum() + l2), low[inner + k], high[inner + k])
        margin = margin + v_out[node - inner]
        features.append(f_out)
        thresholds.append(t_out)
        values.append(v_out)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))
