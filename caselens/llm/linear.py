"""Sparse rows in numpy and a small full-batch optimiser for linear models on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: `col` and `val` of row i lie in [start[i], start[i + 1])."""

    def __init__(self, cols: list[np.ndarray], vals: list[np.ndarray]):
        self.start = np.concatenate(([0], np.cumsum([len(c) for c in cols]))).astype(np.int64)
        self.row = np.repeat(np.arange(len(cols)), np.diff(self.start))
        self.col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
        self.val = np.concatenate(vals).astype(np.float64) if vals else np.zeros(0)
        self.n = len(cols)

    def only(self, live: np.ndarray) -> Rows:
        """The same rows without the columns that aren't live."""
        keep = live[self.col]
        out = Rows([], [])
        out.row, out.col, out.val, out.n = self.row[keep], self.col[keep], self.val[keep], self.n
        out.start = np.concatenate(([0], np.cumsum(np.bincount(out.row, minlength=self.n))))
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], size)


def fit(params: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int = 150, rate: float = 0.05) -> np.ndarray:
    """Adam on the whole sample with a falling rate. Deterministic."""
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        g = gradient(params)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        params = params - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return params
