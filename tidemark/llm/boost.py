"""Gradient-boosted oblivious trees for several classes, in numpy.

Every level of a tree asks one question of all rows, so a row's leaf is a number of as many bits as there are levels
and scoring is a few comparisons of whole columns. Each tree steps all classes at once along the softmax gradient;
splits are found on histograms of up to `BINS` quantile bins of each column.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of (columns, thresholds, leaf values by class) on top of the classes' log shares."""

    def __init__(self, start: np.ndarray):
        self.start = start
        self.trees: list[tuple[list[int], list[float], np.ndarray]] = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log of the class probabilities of each row; `x` holds a column for each feature, as rows."""
        out = np.tile(self.start.astype(np.float32), (x.shape[1], 1))
        for columns, thresholds, leaves in self.trees:
            leaf = np.zeros(x.shape[1], np.int16)
            for column, threshold in zip(columns, thresholds):
                leaf <<= 1
                leaf |= x[column] > threshold
            out += leaves[leaf]
        out -= out.max(1, keepdims=True)
        return out - np.log(np.exp(out).sum(1, keepdims=True))


def _binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = []
    codes = np.zeros(x.shape, np.uint8)
    for k, column in enumerate(x):
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32)
        edges.append(cuts)
        codes[k] = np.searchsorted(cuts, column, side="left")
    return codes, edges


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 60, depth: int = 4, rate: float = 0.25,
        smooth: float = 5.0, share: float = 0.5, seed: int = 5) -> Boosted:
    """Fit on columns `x` (feature, row) and classes `y`; a tree sees `share` of the features, chosen by `seed`."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    codes, edges = _binned(x)
    n = x.shape[1]
    start = np.log((np.bincount(y, minlength=classes) + 1) / (n + classes))
    model = Boosted(start)
    target = np.eye(classes)[y]
    logits = np.tile(start, (n, 1))
    usable = [k for k in range(len(x)) if len(edges[k])]
    if not usable:
        return model
    for _ in range(rounds):
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = target - p
        some = rng.choice(usable, max(1, int(len(usable) * share)), replace=False)
        leaf = np.zeros(n, np.int64)
        columns, thresholds = [], []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for k in some:
                at = leaf * BINS + codes[k]
                size = (1 << level) * BINS
                count = np.bincount(at, minlength=size).reshape(-1, BINS)
                sums = np.stack([np.bincount(at, gradient[:, c], minlength=size).reshape(-1, BINS) for c in range(classes)])
                left, left_n = np.cumsum(sums, 2), np.cumsum(count, 1)
                right, right_n = left[:, :, -1:] - left, left_n[:, -1:] - left_n
                gain = ((left ** 2).sum(0) / (left_n + smooth) + (right ** 2).sum(0) / (right_n + smooth)).sum(0)
                gain = gain[:len(edges[k])]
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), int(k), at)
            _, k, cut = best
            columns.append(k)
            thresholds.append(float(edges[k][cut]))
            leaf = leaf * 2 + (codes[k] > cut)
        size = 1 << depth
        curve = np.bincount(leaf, (p * (1 - p)).sum(1) / classes, minlength=size)
        values = np.stack([np.bincount(leaf, gradient[:, c], minlength=size) for c in range(classes)], 1)
        values = (rate * values / (curve + smooth / 10)[:, None]).astype(np.float32)
        model.trees.append((columns, thresholds, values))
        logits += values[leaf]
    return model
