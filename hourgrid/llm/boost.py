"""Gradient-boosted trees with monotonic constraints, held as flat node arrays.

Training runs on a bounded matrix of labelled rows in the driver; scoring walks all rows of a batch
through all trees level by level, with array look-ups only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth.  Node i of a tree has the children 2i + 1 and 2i + 2;
    ``feature`` and ``threshold`` are (trees, inner nodes), ``value`` is (trees, leaves)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        for _ in range(inner.bit_length() if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.value[trees, node - inner].sum(1) if len(self.feature) else np.full(len(x), self.base)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 32, penalty: float = 1.0, least: int = 8) -> Trees:
    """Second-order boosting of the log loss.  ``monotone`` holds -1, 0 or 1 per feature: a split on a
    constrained feature is taken only if its two values are in that order, and the middle of the two
    bounds every value further down on either side, so the sum of trees keeps the direction.
    With no rows, or rows of one class, the model is that class's smoothed log odds."""
    rows, features = x.shape
    prior = np.log((y.sum() + 0.5) / (rows - y.sum() + 0.5))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(prior))
    if rows < 2 * least or y.min() == y.max():
        return Trees(out.feature[:0], out.threshold[:0], out.value[:0], out.base)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(features)], 1)
    margin = np.full(rows, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(rows, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        weight = {0: _weight(gradient.sum(), hessian.sum(), penalty, bounds[0])}
        for i in range(inner):
            lower, upper = bounds[i]
            at = np.flatnonzero(node == i)
            best = None
            if len(at) >= 2 * least:
                g, h = gradient[at], hessian[at]
                stay = _gain(weight[i], g.sum(), h.sum(), penalty)
                for f in range(features):
                    b = binned[at, f]
                    size = len(cuts[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None))
                    if not len(gl):
                        continue
                    gr, hr = g.sum() - gl, h.sum() - hl
                    wl, wr = (np.clip(-a / (c + penalty), lower, upper) for a, c in ((gl, hl), (gr, hr)))
                    gain = _gain(wl, gl, hl, penalty) + _gain(wr, gr, hr, penalty) - stay
                    ok = (nl >= least) & (len(at) - nl >= least)
                    if monotone[f]:
                        ok &= (wr - wl) * monotone[f] >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                        best = gain[k], f, k, wl[k], wr[k]
            left, right = 2 * i + 1, 2 * i + 2
            if best is None:  # every row goes left and keeps the node's weight
                bounds[left] = bounds[right] = bounds[i]
                weight[left] = weight[right] = weight[i]
                node[at] = left
                continue
            _, f, k, wl, wr = best
            out.feature[t, i], out.threshold[t, i] = f, cuts[f][k]
            weight[left], weight[right] = wl, wr
            middle = (wl + wr) / 2
            bounds[left] = (lower, min(upper, middle)) if monotone[f] > 0 else (max(lower, middle), upper) if monotone[f] < 0 else bounds[i]
            bounds[right] = (max(lower, middle), upper) if monotone[f] > 0 else (lower, min(upper, middle)) if monotone[f] < 0 else bounds[i]
            node[at] = np.where(binned[at, f] > k, right, left)
        out.value[t] = [rate * weight[inner + j] for j in range(leaves)]
        margin += out.value[t][node - inner]
    return out


def _weight(g: float, h: float, penalty: float, bound: tuple[float, float]) -> float:
    return float(np.clip(-g / (h + penalty), *bound))


def _gain(w, g, h, penalty):
    """Loss reduction of the value w for rows with gradient sum g and hessian sum h."""
    return -(g * w + 0.5 * (h + penalty) * w * w)
