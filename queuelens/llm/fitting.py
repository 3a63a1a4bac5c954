"""A small weighted logistic regression, fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, coefficients with the intercept first) by Newton steps; constant columns get scale 1."""
    centre, scale = np.average(x, axis=0, weights=weight), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    beta, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)] * weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, beta


def apply_logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    centre, scale, beta = model
    return 1 / (1 + np.exp(-np.clip(beta[0] + ((x - centre) / scale) @ beta[1:], -30, 30)))
