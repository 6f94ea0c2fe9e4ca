"""Histogram decision trees in numpy: gradient boosting and random forests, as complete trees in flat arrays.

A tree of depth D has 2^D - 1 inner places in level order; `feature` and `threshold` are their tests (a value goes right
if it is above the threshold; a place that does not split sends all left by an infinite threshold) and `value` its 2^D leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2^D - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2^D)
    base: float = 0.0

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Base plus the sum of the leaves that each row reaches, all rows at once, a level at a time."""
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def _tree(b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree by the gain of sum(g)^2 / (sum(h) + ridge); returns its arrays and the leaf of each row."""
    bins, inner = int(b.max(initial=0)) + 1, 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(b), np.int64)
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        here = at - first
        gain = np.full((nodes,), 1e-9)
        best_f, best_t = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        best_bin = np.full(nodes, bins)
        total_g, total_h = np.bincount(here, g, nodes), np.bincount(here, h, nodes)
        for f in pick(level):
            if not len(edges[f]):
                continue
            key = here * bins + b[:, f]
            lg = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)[:, : len(edges[f])]
            lh = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)[:, : len(edges[f])]
            rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
            found = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
            found[(lh < least) | (rh < least)] = -1
            k = found.argmax(1)
            top = found[np.arange(nodes), k]
            better = top > gain
            gain[better], best_f[better], best_bin[better], best_t[better] = top[better], f, k[better], edges[f][k[better]]
        feature[first : first + nodes], threshold[first : first + nodes] = best_f, best_t
        at = 2 * at + 1 + (b[np.arange(len(b)), best_f[here]] > best_bin[here])
    leaf = at - inner
    sums, weights = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
    return feature, threshold, sums / (weights + ridge), leaf


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for c, e in zip(x.T, edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 63, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the log-odds of y = 1. No rows, or one class only: the (smoothed) base rate alone."""
    p = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), base)
    edges = _edges(x, bins)
    b, score, grown = _binned(x, edges), np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        f, t, v, leaf = _tree(b, edges, y - q, q * (1 - q), depth, least, ridge, lambda _: range(x.shape[1]))
        grown.append((f, t, rate * v))
        score += rate * v[leaf]
    return Trees(*(np.stack(a) for a in zip(*grown)), base)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, bins: int = 63, least: float = 3.0, seed: int = 7) -> Trees:
    """Random forest: bootstrap rows, a random part of the features at each level; the mean of the leaves is P(y = 1)."""
    rng, edges, grown = np.random.default_rng(seed), _edges(x, bins), []
    b, n_f = _binned(x, edges), x.shape[1]
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        pick = lambda _: rng.permutation(n_f)[: max(2, int(np.ceil(n_f / 2)))]
        f, t, v, _ = _tree(b, edges, w * (y - y.mean()), w, depth, least, 1e-6, pick)
        grown.append((f, t, (v + y.mean()) / trees))
    return Trees(*(np.stack(a) for a in zip(*grown)))
