"""Gradient-boosted trees on histograms, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .calibration import sigmoid


@dataclass
class Trees:
    """All trees' nodes in flat arrays; row t of roots is tree t. A leaf is its own child on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray  # a row goes left if its feature is at most this
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x: every tree at once, one level a step."""
        x = np.asarray(x, float)
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def train(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Trees for P(y = 1) by second-order boosting of the logistic loss.

    monotone: for each feature 1 (never falls as it grows), -1 (never rises) or 0. A split that breaks its constraint is
    not taken, and both sides' later values stay on their side of the middle between them.
    """
    x, y = np.asarray(x, float).reshape(-1, len(monotone)), np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if len(y) else np.zeros((0, len(monotone)), int)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple | None:
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), None
        whole = total_g**2 / (total_h + ridge)
        for f in range(len(monotone)):
            n = len(edges[f])
            if not n:
                continue
            c = codes[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, n + 1))[:-1] for w in (g[rows], h[rows], None))
            gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
            a, b = (np.clip(-p / (q + ridge), low, high) for p, q in ((gl, hl), (gr, hr)))
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
            gain[(nl < least) | (nr < least) | (monotone[f] * (b - a) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, a[k], b[k])
        return best

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_over: int, low: float, high: float) -> int:
        found = best_split(rows, g, h, low, high) if left_over and len(rows) >= 2 * least else None
        if found is None:
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)) * rate
            margin[rows] += value
            return leaf(value)
        _, f, k, a, b = found
        middle = (a + b) / 2
        mine = leaf(0.0)
        goes_left = codes[rows, f] <= k
        sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
        children = [grow(part, g, h, left_over - 1, *bounds) for part, bounds in zip((rows[goes_left], rows[~goes_left]), sides)]
        nodes[mine] = [f, edges[f][k], *children, 0.0]
        return mine

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = sigmoid(margin)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(np.array(roots, int), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], depth, base)
