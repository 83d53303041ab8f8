"""Small learners in numpy: boosted trees, isotonic regression, logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Forest:
    """Trees of one depth in arrays: node k has the children 2k+1 and 2k+2."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Forest:
    """Logistic loss, second-order gains, histograms over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    edges = [np.unique(np.append(e, [0.0])) for e in edges]  # most features are zero for most texts
    wide = max(map(len, edges)) + 1
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    forest = Forest(float(np.log(prior / (1 - prior))))
    z, inner = np.full(len(y), forest.base), 2**depth - 1
    grown = []
    for _ in range(trees):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best, gain = np.zeros(n, np.int64), np.full(n, 1e-6)
            for f, c in enumerate(code):
                key = (node - first) * wide + c
                left_g = np.bincount(key, g, n * wide).reshape(n, wide).cumsum(1)
                left_h = np.bincount(key, h, n * wide).reshape(n, wide).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gains = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gains = gains[:, : len(edges[f])]
                top = gains.argmax(1)
                value = gains[np.arange(n), top]
                better = value > gain
                gain[better], best[better] = value[better], top[better]
                feature[first : first + n][better] = f
                cut[first : first + n][better] = edges[f][top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        sum_g, sum_h = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -rate * sum_g / (sum_h + ridge)
        z += leaf[at]
        grown.append((feature, cut, leaf))
    forest.feature, forest.cut, forest.leaf = (np.stack(a) for a in zip(*grown, strict=True))
    return forest


@dataclass
class Isotonic:
    """A rising map, linear between its points."""

    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def constant(value: float) -> Isotonic:
        return Isotonic(np.array([0.0]), np.array([float(value)]))

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.at, self.value)


def fit_isotonic(z: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each block counts with one unsure half label of either kind."""
    at, place = np.unique(z, return_inverse=True)
    weight, total = np.bincount(place).astype(float), np.bincount(place, y)
    blocks: list[list[float]] = []  # label sum, weight, first and last place
    for k, (w, s) in enumerate(zip(weight, total, strict=True)):
        blocks.append([s, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    value = np.array([b[0] / b[1] for b in blocks])
    first, last = np.array([int(b[2]) for b in blocks]), np.array([int(b[3]) for b in blocks])
    return Isotonic(np.stack([at[first], at[last]], 1).ravel(), np.repeat(value, 2))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ b)
        grad = x.T @ (weight * (p - y)) + penalty @ b
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return b
