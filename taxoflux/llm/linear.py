"""Linear models on sparse 0/1 features, fitted on bounded samples."""
from __future__ import annotations

import numpy as np


def hinge_by_dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 6) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent.

    Row i has the features rows[i], each worth scale[f] and brought to unit length; y is +1 or -1;
    cost[i] bounds its dual variable.  The last weight is the bias."""
    rng = np.random.default_rng(seed)
    length = np.array([max(1e-12, np.sqrt(scale[r] @ scale[r])) for r in rows])  # values are made anew each time: rows are small, all of them aren't
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r] / length[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # |x|**2 is 1, and 1 for the bias
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) is the chance of label 1; targets as in Platt's paper."""
    positive, negative = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        gradient = x.T @ (p - target)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))
