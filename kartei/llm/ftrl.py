"""Sparse multinomial logistic regression: follow-the-regularised-leader with elastic net, and temperature calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Rows scored at once, and rows of a training step.
ROWS, STEP = 256, 64


@dataclass
class Softmax:
    """weights: (features, classes) float32; idf: weight of a feature's count; scale: what a row's weights sum to."""

    weights: np.ndarray
    idf: np.ndarray
    scale: float
    temperature: float = 1.0

    def logits(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Scores of rows given as flat feature numbers and row offsets. A row without features scores 0 everywhere."""
        n = len(off) - 1
        out = np.zeros((n, self.weights.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(off))
        if len(full):
            w = self.idf[idx]
            total = np.add.reduceat(w, off[full])
            for at in range(0, len(full), ROWS):
                rows = full[at : at + ROWS]
                a, b = off[rows[0]], off[rows[-1] + 1]
                out[rows] = np.add.reduceat(w[a:b, None] * self.weights[idx[a:b]], off[rows] - a, axis=0) * (self.scale / total[at : at + ROWS, None])
        return out

    def probabilities(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.logits(idx, off) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def inverse_frequency(idx: np.ndarray, off: np.ndarray, dim: int) -> np.ndarray:
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    seen = np.unique(row.astype(np.int64) * dim + idx) % dim
    return np.log((len(off)) / (1 + np.bincount(seen, minlength=dim))).clip(0.1).astype(np.float32)


def fit(idx: np.ndarray, off: np.ndarray, y: np.ndarray, classes: int, dim: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, scale: float = 10.0, held_out: int = 8, seed: int = 7) -> Softmax:
    """Every held_out-th row (in a shuffled order) is kept for the temperature."""
    rng = np.random.default_rng(seed)
    idf = inverse_frequency(idx, off, dim)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    cell, times = np.unique(row * dim + idx, return_counts=True)
    row, feature = cell // dim, cell % dim
    value = times * idf[feature]
    total = np.bincount(row, value, len(off) - 1)
    value = (value * scale / total[row]).astype(np.float32)
    start = np.searchsorted(row, np.arange(len(off)))
    order = rng.permutation(len(off) - 1)
    kept, train = order[::held_out], np.delete(order, np.arange(0, len(order), held_out))
    if not len(train):
        train = order
    z, root = np.zeros((dim, classes), np.float32), np.zeros((dim, classes), np.float32)  # root: of the sum of squared gradients
    seen, place = np.zeros(dim, bool), np.zeros(dim, np.int64)

    def current(f: np.ndarray) -> np.ndarray:
        zi = z[f]
        return -(zi - np.sign(zi) * l1) * (np.abs(zi) > l1) / ((beta + root[f]) / alpha + l2)

    for _ in range(epochs):
        some = rng.permutation(train)
        some = some[start[some + 1] > start[some]]
        for k in range(0, len(some), STEP):
            step = some[k : k + STEP]
            size = start[step + 1] - start[step]
            at = np.repeat(start[step] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            seen[feature[at]] = True
            f = np.flatnonzero(seen)
            seen[f] = False
            place[f] = np.arange(len(f))
            x = np.zeros((len(step), len(f)), np.float32)
            x[np.repeat(np.arange(len(step)), size), place[feature[at]]] = value[at]
            w = current(f)
            s = x @ w
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(step)), y[step]] -= 1
            new = np.sqrt(root[f] ** 2 + (x * x).T @ (p * p))
            z[f] += x.T @ p - (new - root[f]) / alpha * w
            root[f] = new
    model = Softmax(current(np.arange(dim)).astype(np.float32), idf, scale)
    model.temperature = calibrate(np.concatenate([model.logits(*pick(idx, off, r)) for r in kept]) if len(kept) else np.zeros((0, classes)), y[kept])
    return model


def pick(idx: np.ndarray, off: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    return idx[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]])


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-out rows."""
    if not len(y):
        return 1.0
    best, temperature = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.35), np.log(8), 41)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    return temperature
