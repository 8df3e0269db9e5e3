"""Gradient-boosted trees for binary labels, in numpy: logistic loss, binned
features, trees of fixed depth, Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROUNDS = 60
DEPTH = 3
BINS = 16
RATE = 0.2
L2 = 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """``trees``: for each, features and thresholds of the inner nodes (heap
    order) and the leaf values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(base=float(np.log(mean / (1 - mean))))
        margin = np.full(n, model.base)
        for _ in range(ROUNDS):
            p = _sigmoid(margin)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            inner = 2**DEPTH - 1
            chosen, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for depth in range(DEPTH):
                first, nodes = 2**depth - 1, 2**depth
                best = np.full(nodes, 1e-6)
                splits = [(0, BINS)] * nodes
                for f in range(width):
                    key = node * BINS + binned[:, f]
                    gs = np.bincount(key, weights=g, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                    hs = np.bincount(key, weights=h, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + L2) + (total_g - gs) ** 2 / (total_h - hs + L2) - total_g**2 / (total_h + L2)
                    at = gain.argmax(axis=1)
                    for k in range(nodes):
                        if at[k] < len(cuts[f]) and gain[k, at[k]] > best[k]:
                            best[k], splits[k] = gain[k, at[k]], (f, int(at[k]))
                for k, (f, b) in enumerate(splits):
                    chosen[first + k] = f
                    limit[first + k] = cuts[f][b] if b < len(cuts[f]) else np.inf
                node = 2 * node + (x[np.arange(n), chosen[first + node]] >= limit[first + node])
            leaf = RATE * np.bincount(node, weights=g, minlength=2**DEPTH) / (np.bincount(node, weights=h, minlength=2**DEPTH) + L2)
            margin += leaf[node]
            model.trees.append((chosen, limit, leaf))
        return model

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for chosen, limit, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for depth in range(DEPTH):
                at = 2**depth - 1 + node
                node = 2 * node + (x[rows, chosen[at]] >= limit[at])
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that were not fitted on."""
        m = self.margins(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        w = np.array([1.0, 0.0])
        z = np.stack([m, np.ones(len(m))], axis=1)
        for _ in range(50):
            p = _sigmoid(z @ w)
            hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, z.T @ (target - p))
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = float(w[0]), float(w[1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(x) + self.shift)
