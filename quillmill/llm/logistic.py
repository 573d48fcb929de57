"""A small logistic regression for calibrating scores on the driver, over a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with step halving -> (weights with the intercept last, means, scales); one class alone gives a constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    ridge = l2 * len(y) * 0.1 * np.array([*[1.0] * (len(w) - 1), 1e-6])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + (ridge * w * w).sum() / 2)

    if 0 < y.sum() < len(y):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            move = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            now, size = loss(w), 1.0
            while size > 1e-6 and loss(w - size * move) > now:  # halve a step that overshoots
                size /= 2
            w -= size * move
            if np.abs(size * move).max() < 1e-8:
                break
    return w, mean, scale


def predict(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))
