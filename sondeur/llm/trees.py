"""Histogram gradient-boosted trees and isolation forests in numpy, flattened for vectorised traversal.

A tree of depth D is a complete binary tree: node i has children 2i+1 and 2i+2, and a row goes right where its
feature exceeds the threshold.  An unsplit node has an infinite threshold, so rows pass left to a leaf below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """feature, threshold: (trees, 2^depth - 1); leaf: (trees, 2^depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def total(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The sum of leaf values over all trees, and the base, for each row of x."""
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        out = np.empty(len(x))
        feature, threshold, leaf = self.feature.ravel(), self.threshold.ravel(), self.leaf.ravel()
        for i in range(0, len(x), rows):
            part = np.ascontiguousarray(x[i : i + rows])
            flat, width = part.ravel(), part.shape[1]
            line = (np.arange(len(part)) * width)[:, None]
            tree = np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(part), len(self.leaf)), np.int64)
            for _ in range(depth):
                at = tree * inner + node
                node = 2 * node + 1 + (flat[line + feature[at]] > threshold[at])
            out[i : i + rows] = leaf[tree * (inner + 1) + node - inner].sum(axis=1)
        return out + self.base


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> FlatTrees:
    """Logistic loss by second-order boosting; splits are sought in histograms of at most `bins` quantile bins.

    With no rows, or one class only, the trees are empty and the base is the class's log-odds, held within 4.
    """
    n, width = x.shape
    inner = 2**depth - 1
    rows = 0 if n == 0 or y.min() == y.max() else trees
    feature, threshold, leaf = np.zeros((rows, inner), np.int64), np.full((rows, inner), np.inf), np.zeros((rows, inner + 1))
    rate0 = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.clip(np.log(rate0 / (1 - rate0)), -4, 4))
    if not rows:
        return FlatTrees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # code > k: x > edge k
    last = np.array([len(e) for e in edges])
    margin = np.full(n, base)
    for t in range(rows):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k = 2**level
            first = k - 1
            key = (((node - first)[:, None] * width + np.arange(width)) * bins + code).ravel()
            hg = np.bincount(key, np.repeat(g, width), k * width * bins).reshape(k, width, bins).cumsum(axis=2)
            hh = np.bincount(key, np.repeat(h, width), k * width * bins).reshape(k, width, bins).cumsum(axis=2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hh < least) | (th - hh < least) | (np.arange(bins)[None, None, :] >= last[None, :, None])] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            split = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            feature[t, first : first + k] = f
            threshold[t, first : first + k] = [edges[f[i]][b[i]] if split[i] else np.inf for i in range(k)]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        slot = node - inner
        leaf[t] = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        margin += leaf[t, slot]
    return FlatTrees(feature, threshold, leaf, base)


def _unsuccessful(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    trees: FlatTrees
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / c): near 1 for rows that few random splits cut off."""
        return np.exp2(-self.trees.total(x) / len(self.trees.leaf) / self.scale)


def fit_isolation(x: np.ndarray, trees: int = 200, sample: int = 256, depth: int = 8, seed: int = 7) -> IsolationForest:
    """Each tree parts a random sample by random features at random thresholds; leaves hold path lengths.

    The threshold is drawn over the range of all of x widened by nothing, and a feature that is constant in a node is
    not drawn.  With no rows, every path is the same and every score is 1/2.
    """
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    size = min(sample, len(x))
    scale = float(_unsuccessful(np.array(size))) or 1.0
    if size < 2:
        return IsolationForest(FlatTrees(feature, threshold, leaf + scale, 0.0), scale)
    for t in range(trees):
        stack = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while stack:
            node, level, part = stack.pop()
            span = np.ptp(part, axis=0) if len(part) else np.zeros(x.shape[1])
            if level == depth or len(part) < 2 or not (span > 0).any():
                low = node  # all leaves below hold this node's path length
                high = node
                for _ in range(depth - level):
                    low, high = 2 * low + 1, 2 * high + 2
                leaf[t, low - inner : high - inner + 1] = level + _unsuccessful(np.array(len(part)))
                continue
            f = rng.choice(np.flatnonzero(span > 0))
            cut = part[:, f].min() + rng.random() * span[f]
            feature[t, node], threshold[t, node] = f, cut
            right = part[:, f] > cut
            stack += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
    return IsolationForest(FlatTrees(feature, threshold, leaf, 0.0), scale)


def calibrated(score: np.ndarray, bad: np.ndarray, spare: float, rows: np.ndarray | None = None) -> float:
    """The threshold above which rows are rejected: the best balance of bad rows caught over good rows lost, among
    thresholds that lose at most the share `spare` of good rows.  Midway between neighbours; inf where a class is missing.
    Each score stands for `rows` rows, or for one.
    """
    bad = bad.astype(bool)
    if not bad.any() or bad.all():
        return float("inf")
    rows = np.ones(len(score), np.int64) if rows is None else rows
    values, at = np.unique(score, return_inverse=True)
    cuts = np.append((values[:-1] + values[1:]) / 2, values[-1] + 1e-9)
    counts = [np.bincount(at[x], rows[x], len(values)) for x in (bad, ~bad)]
    caught, lost = (1 - np.cumsum(n) / n.sum() for n in counts)
    fine = lost <= spare + 1e-12
    return float(cuts[fine][np.argmax((caught - lost)[fine])])
