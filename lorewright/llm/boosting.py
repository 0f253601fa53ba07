"""Small gradient-boosted trees and isotonic calibration in numpy, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trees:
    """Logistic gradient boosting over quantile bins; every split maximises the second-order gain."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 8.0, least: int = 15):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # a rare positive value must be tellable from zero, whatever the quantiles
        self.edges = [np.unique(np.concatenate([e, [0.0], np.quantile(c[c > 0], [0.25, 0.5, 0.75]) if (c > 0).any() else []])) for e, c in zip(self.edges, x.T)]
        coded = self._code(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds):
            p = _sigmoid(score)
            tree = self._tree(coded, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._walk(tree, coded)
        return self

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def _tree(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner, int), np.zeros(2 * inner + 1)
        node = np.zeros(len(g), int)
        width = max(len(e) for e in self.edges) + 1
        for k in range(inner):
            here = np.flatnonzero(node == k)
            if len(here) < 2 * self.least:
                continue
            best = 1e-6
            for f in range(coded.shape[1]):
                c = coded[here, f]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, width))[:-1] for w in (g[here], h[here], np.ones(len(here))))
                tg, th = g[here].sum(), h[here].sum()
                gain = gs**2 / (hs + self.ridge) + (tg - gs) ** 2 / (th - hs + self.ridge) - tg**2 / (th + self.ridge)
                gain[(ns < self.least) | (len(here) - ns < self.least)] = 0
                if gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), f, int(gain.argmax())
            if feature[k] >= 0:
                node[here] = 2 * k + 1 + (coded[here, feature[k]] > cut[k])
        for k in np.unique(node):
            value[k] = -self.rate * g[node == k].sum() / (h[node == k].sum() + self.ridge)
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], coded: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(coded), int), np.arange(len(coded))
        for _ in range(self.depth):
            f = np.where(node < len(feature), feature[np.minimum(node, len(feature) - 1)], -1)
            step = 2 * node + 1 + (coded[rows, np.maximum(f, 0)] > cut[np.minimum(node, len(cut) - 1)])
            node = np.where(f >= 0, step, node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        coded = self._code(x)
        return self.base + sum((self._walk(t, coded) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool-adjacent-violators fit of a rising step function, read off by linear interpolation."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, lowest and highest score
        for v, t in zip(s[order], y[order]):
            if blocks and blocks[-1][3] == v:  # equal scores stay together
                m, w, lo, hi = blocks.pop()
                blocks.append([(m * w + t) / (w + 1), w + 1, lo, hi])
            else:
                blocks.append([float(t), 1.0, v, v])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, _, hi = blocks.pop()
                m2, w2, lo, _ = blocks.pop()
                blocks.append([(m * w + m2 * w2) / (w + w2), w + w2, lo, hi])
        self.x = np.array([z for b in blocks for z in b[2:]])
        # eight cases of the mean rate keep short blocks and the ends from extremes
        self.y = np.array([z for b in blocks for z in [(b[0] * b[1] + 8 * y.mean()) / (b[1] + 8)] * 2])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(s, self.x, self.y), 0, 1)
