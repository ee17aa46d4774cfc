"""Gradient-boosted trees on small integer features, with a calibrated threshold; trained on the driver, applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Depth-limited regression trees for the logistic loss, each grown on a random ``sample`` of the rows. Features are integers, clipped to 0..BINS-1."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    penalty: float = 1.0
    weight: float = 2.0
    sample: float = 0.5
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    model: list[list[tuple[int, int, float]]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Boosted:
        """Train on three quarters of the rows; calibrate scores and threshold on the rest."""
        x = np.clip(x, 0, BINS - 1).astype(np.int64)
        part = np.random.default_rng(seed).random(len(y)) < 0.75
        self._boost(x[part], y[part].astype(float))
        held_x, held_y = (x[~part], y[~part].astype(float)) if (~part).sum() > 20 else (x, y.astype(float))
        self._calibrate(self.score(held_x), held_y)
        return self

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        r = np.random.default_rng(len(y))
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            part = np.nonzero(r.random(len(y)) < self.sample)[0]
            nodes = self._grow(x[part], (q - y)[part], (q * (1 - q))[part])
            self.model.append(nodes)
            f += self._leaf(nodes, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """A complete binary tree as an array: (feature, bin, value); feature -1 marks a leaf."""
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        at = np.zeros(len(g), dtype=np.int64)
        for node in range(len(nodes)):
            rows = np.nonzero(at == node)[0]
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[node] = (-1, 0, float(-self.rate * gs / (hs + self.penalty)))
            if len(rows) < 8 or node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            wide, k = x.shape[1], (x[rows] + np.arange(x.shape[1]) * BINS).ravel()
            sums = lambda v: np.bincount(k, np.repeat(v[rows], wide), wide * BINS).reshape(wide, BINS).cumsum(axis=1)[:, :-1]
            cg, ch = sums(g), sums(h)
            gain = cg**2 / (ch + self.penalty) + (gs - cg) ** 2 / (hs - ch + self.penalty) - gs**2 / (hs + self.penalty)
            at_best = int(gain.argmax())
            if gain.flat[at_best] > best[0]:
                best = (float(gain.flat[at_best]), at_best // (BINS - 1), at_best % (BINS - 1))
            if best[1] >= 0:
                nodes[node] = (best[1], best[2], 0.0)
                at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        return nodes

    def _leaf(self, nodes: list[tuple[int, int, float]], x: np.ndarray) -> np.ndarray:
        features, bins, values = (np.array(c) for c in zip(*nodes, strict=True))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            k = features[at]
            inner = k >= 0
            step = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(k, 0)] > bins[at])
            at = np.where(inner, step, at)
        return values[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        x = np.clip(x, 0, BINS - 1).astype(np.int64)
        return self.base + sum((self._leaf(n, x) for n in self.model), np.zeros(len(x)))

    def _calibrate(self, s: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by a few Newton steps, then the threshold of the best F-score (the middle, where several are best).

        With ``weight`` 2 a missed row counts for more than a wrong one.
        """
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w, r = p * (1 - p) + 1e-9, p - target
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, [(r * s).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        self.scale = (float(a), float(b))
        p, grid = self.probability_of(s), np.linspace(0.05, 0.95, 91)
        both = self.weight**2
        score = np.array([(1 + both) * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + both * y.sum()) for t in grid])
        self.threshold = float(np.median(grid[score >= score.max() - 1e-9]))

    def probability_of(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * s + self.scale[1], -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each row."""
        return self.probability_of(self.score(x))
