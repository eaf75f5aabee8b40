"""Gradient-boosted trees for two classes in numpy, with a calibrated threshold."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees on quantile bins, logistic loss; scores become probabilities by a fitted logistic curve."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 4) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def _tree(self, codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), dtype=np.int64)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[k] = -gs / (hs + 1.0)
            if k >= size // 2 or len(own) < 2 * self.least:
                continue
            best, where = 1e-6, None
            for f in range(codes.shape[1]):
                gl = np.cumsum(np.bincount(codes[own, f], g[own], self.bins))[:-1]
                hl = np.cumsum(np.bincount(codes[own, f], h[own], self.bins))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                at = int(gain.argmax())
                if gain[at] > best and at < len(edges[f]):
                    best, where = gain[at], (f, at)
            if where is None:
                continue
            f, at = where
            feature[k], cut[k] = f, edges[f][at]
            left = codes[own, f] <= at
            node[own[left]], node[own[~left]] = 2 * k + 1, 2 * k + 2
        return feature, cut, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            node = np.where(go, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._apply(tree, x)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 1, held: float = 0.25, recall_weight: float = 1.0) -> Boosted:
        """Grow on a part of the rows; fit the curve and choose the threshold of the best F score on the rest."""
        rng = np.random.default_rng(seed)
        part = rng.random(len(y)) >= held
        tx, ty = x[part], y[part].astype(float)
        edges = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])]
        edges = [np.unique((e[:-1] + e[1:]) / 2) if len(e) > 1 else e for e in edges]
        codes = np.stack([np.searchsorted(e, tx[:, f], side="left") for f, e in enumerate(edges)], 1)
        share = min(max(ty.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(ty), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(codes, edges, p - ty, p * (1 - p))
            self.trees.append(tree)
            score += self.rate * self._apply(tree, tx)
        hx, hy = x[~part], y[~part].astype(float)
        z = np.clip(self.raw(hx), -12, 12)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a -= 0.05 * float(((p - hy) * z).mean() + 0.01 * (a - 1))
            b -= 0.05 * float((p - hy).mean())
        self.slope, self.shift = a, b
        p = self.probability(hx)
        best = -1.0
        for t in np.linspace(0.1, 0.9, 33):
            hit, said = float(((p >= t) & (hy > 0)).sum()), float((p >= t).sum())
            f = (1 + recall_weight) * hit / max(said + recall_weight * hy.sum(), 1e-9)
            if f > best + 1e-9 or (abs(f - best) <= 1e-9 and abs(t - 0.5) < abs(self.threshold - 0.5)):
                best, self.threshold = f, float(t)
        self.held_score = best
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.clip(self.raw(x), -12, 12) + self.shift))) if len(x) else np.zeros(0)
