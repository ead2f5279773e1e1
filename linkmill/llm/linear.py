"""Logistic regression on sparse rows and calibration, for samples of bounded size."""

from __future__ import annotations

import numpy as np


class Rows:
    """A sparse matrix by rows: bounds (n + 1), columns and values."""

    def __init__(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.bounds, self.columns, self.values, self.width = bounds, columns, values, width
        self.row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.bounds)[rows]
        bounds = np.append(0, np.cumsum(size))
        at = np.repeat(self.bounds[:-1][rows] - bounds[:-1], size) + np.arange(bounds[-1])
        return Rows(bounds, self.columns[at], self.values[at], self.width)

    def with_dense(self, dense: np.ndarray) -> Rows:
        """Dense columns put behind the sparse ones."""
        n, k = dense.shape
        if not k:
            return self
        size = np.diff(self.bounds)
        bounds = np.append(0, np.cumsum(size + k))
        columns, values = np.empty(bounds[-1], self.columns.dtype), np.empty(bounds[-1])
        at = np.repeat(bounds[:-1] - self.bounds[:-1], size) + np.arange(len(self.columns))
        columns[at], values[at] = self.columns, self.values
        more = (bounds[1:, None] - k) + np.arange(k)
        columns[more], values[more] = self.width + np.arange(k), dense
        return Rows(bounds, columns, values, self.width + k)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.columns] * self.values, minlength=len(self))

    def back(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=rows[self.row] * self.values, minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(x: Rows, y: np.ndarray, penalty: float = 1.0, steps: int = 80, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last for the constant, of a penalised logistic regression; accelerated gradient steps scaled by curvature."""
    n = len(x)
    weight = np.ones(n) if weight is None else weight
    if not n:
        return np.zeros(x.width + 1)
    squares = np.bincount(x.columns, weights=x.values**2 * weight[x.row], minlength=x.width)
    # A row's values share its curvature: with m values per row the diagonal times m bounds the whole.
    share = np.abs(x.values).sum() / max(n, 1)
    scale = np.append(np.sqrt(squares + 1e-12) * np.sqrt(squares.max(initial=1.0)) / 4 + penalty, weight.sum() / 4 + 1e-9)
    theta = np.zeros(x.width + 1)
    theta[-1] = log_odds(np.array([(y @ weight) / max(weight.sum(), 1e-9)]))[0]
    ahead, momentum, best, rate = theta.copy(), 1.0, np.inf, 1.0 / max(1.0, min(share, 8.0))
    for _ in range(steps):
        p = sigmoid(x.dot(ahead[:-1]) + ahead[-1])
        loss = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + penalty / 2 * (ahead[:-1] ** 2).sum()
        if loss > best * 1.0001:
            momentum, ahead, rate = 1.0, theta.copy(), rate / 2
            best = np.inf
            continue
        best = min(best, loss)
        error = weight * (p - y)
        gradient = np.append(x.back(error) + penalty * ahead[:-1], error.sum())
        following = ahead - rate * gradient / scale
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = following + (momentum - 1) / faster * (following - theta)
        theta, momentum = following, faster
    return theta


def predict(x: Rows, theta: np.ndarray) -> np.ndarray:
    """Log odds."""
    return x.dot(theta[:-1]) + theta[-1]


def folds(ids: np.ndarray, count: int) -> np.ndarray:
    """The fold of each id, by its hash."""
    from linkmill.llm.pretoken import MULTIPLIER, mixed

    return (mixed(ids.astype(np.int64).view(np.uint64) * MULTIPLIER) % np.uint64(count)).astype(np.int64)


def calibration(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of Platt's sigmoid over scores, by Newton's method with Platt's targets."""
    positive, negative = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    for _ in range(50):
        p = sigmoid(a * scores + b)
        gradient = x.T @ (p - target) + 1e-3 * np.array([a - 1, b])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
