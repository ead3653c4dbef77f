"""Linear hinge-loss models by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, n_features: int, cost: float = 1.0, weights: np.ndarray | None = None, epochs: int = 20, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum_i cost_i * max(0, 1 - y_i w.x_i), one dual variable at a time.

    ``rows`` and ``values``: each example's feature numbers and their values; labels are +1 and -1. The bias
    is one more feature of value 1. ``weights`` scale each example's cost.
    """
    w, bias = np.zeros(n_features), 0.0
    alpha = np.zeros(len(rows))
    upper = cost * (np.ones(len(rows)) if weights is None else weights)
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            y, x, v = labels[i], rows[i], values[i]
            gradient = y * (float(w[x] @ v) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] >= upper[i] else gradient
            worst = max(worst, abs(projected))
            if abs(projected) > 1e-12:
                before = alpha[i]
                alpha[i] = min(max(before - gradient / square[i], 0.0), upper[i])
                step = (alpha[i] - before) * y
                w[x] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias
