"""Small linear models on the driver, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept.  y may be soft."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ b)
        grad = x.T @ (weight * (p - y)) + ridge * b
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, grad)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return b


def fit_codes(codes: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 30, chunk: int = 1024) -> np.ndarray:
    """:func:`fit_dense` on one-hot features given as the columns (row, feature) that are 1.

    The rows are laid out ``chunk`` at a time, so memory is that of the codes.
    """
    ridge = np.full(width + 1, l2)
    ridge[-1] = 1e-6
    b = np.zeros(width + 1)
    for _ in range(steps):
        p = sigmoid(b[codes].sum(axis=1) + b[-1])
        slope, curve = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        grad, hess = ridge * b, np.diag(ridge)
        for lo in range(0, len(codes), chunk):
            x = np.zeros((len(codes[lo : lo + chunk]), width + 1))
            np.put_along_axis(x, codes[lo : lo + chunk], 1.0, axis=1)
            x[:, -1] = 1.0
            grad += x.T @ slope[lo : lo + chunk]
            hess += (x * curve[lo : lo + chunk, None]).T @ x
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return b


def fit_sparse(rows: np.ndarray, cols: np.ndarray, n: int, width: int, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 400, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features given as (row, col) pairs, by adaptive gradient steps."""
    b, c = np.zeros(width), 0.0
    sq, sqc = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        p = sigmoid(np.bincount(rows, weights=b[cols], minlength=n) + c)
        e = weight * (p - y)
        g = np.bincount(cols, weights=e[rows], minlength=width) + l2 * b
        gc = float(e.sum())
        sq += g * g
        sqc += gc * gc
        b -= rate * g / np.sqrt(sq)
        c -= rate * gc / np.sqrt(sqc)
    return b, c


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities."""
    if len(raw) < 2 or np.ptp(raw) == 0:
        return 1.0, 0.0
    a, b = fit_dense(raw[:, None], y, weight, l2=1e-3)
    return float(a), float(b)
