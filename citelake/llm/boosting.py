"""Gradient-boosted regression trees for a yes/no target, in numpy: small, exact and seeded."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, exact greedy splits, Newton leaves. Inputs are few (thousands of rows)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list[tuple]] = []
        self.start = 0.0
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    def _grow(self, tree: list, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
        at = len(tree)
        tree.append(("leaf", self.rate * g.sum() / (h.sum() + self.least)))
        best, floor = None, g.sum() ** 2 / (h.sum() + self.least) + 1e-6
        for j in range(x.shape[1] if depth else 0):
            order = np.argsort(x[:, j], kind="stable")
            v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + self.least) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + self.least)
                k = int(gain.argmax())
                if gain[k] > floor:
                    best, floor = (j, (v[cut[k]] + v[cut[k] + 1]) / 2), gain[k]
        if best:
            low = x[:, best[0]] <= best[1]
            left = self._grow(tree, x[low], g[low], h[low], depth - 1)
            right = self._grow(tree, x[~low], g[~low], h[~low], depth - 1)
            tree[at] = ("split", *best, left, right)
        return at

    def _tree(self, tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if tree[at][0] == "leaf":
                out[rows] = tree[at][1]
            elif len(rows):
                low = x[rows, tree[at][1]] <= tree[at][2]
                todo += [(tree[at][3], rows[low]), (tree[at][4], rows[~low])]
        return out

    def _score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on held-out rows, by Newton steps on two numbers."""
        z = self._score(x)
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((y - p) * z).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
            m = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(m, g), -1, 1)
        self.slope, self.shift = float(a), float(b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self._score(x) + self.shift))) if len(x) else np.zeros(0)
