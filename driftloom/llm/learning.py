"""Follow-the-regularised-leader with elastic net for linear models on sparse features, and calibration.

Defined cases: an example without features moves the bias only; no examples leave all weights at zero; no rows to
calibrate on give a temperature of 1. The order of examples is drawn from the seed, so that reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Example:
    """One labelled row: distinct feature numbers and their values; the same for its swapped counterpart, if any."""

    label: int
    index: np.ndarray
    value: np.ndarray
    other_index: np.ndarray | None = None
    other_value: np.ndarray | None = None


class Ftrl:
    """Per-coordinate FTRL-proximal for a softmax over classes (one column for two classes: a sigmoid)."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.columns = 1 if classes == 2 else classes
        self.z, self.n = np.zeros((size + 1, self.columns)), np.zeros((size + 1, self.columns))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _move(self, index: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[index]
        sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha
        self.z[index] += gradient - sigma * weights
        self.n[index] = n + gradient**2

    def _with_bias(self, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(index, len(self.z) - 1), np.append(value, 1.0)

    def learn(self, e: Example, importance: float = 1.0, swap_penalty: float = 0.0) -> None:
        index, value = self._with_bias(e.index, e.value)
        w = self.weights(index)
        p = probabilities(value @ w)
        truth = np.zeros_like(p)
        truth[e.label if self.columns > 1 else 0] = 1.0 if self.columns > 1 else float(e.label)
        self._move(index, w, importance * value[:, None] * (p - truth)[None, :])
        if swap_penalty and e.other_index is not None:
            # gradient of swap_penalty * (score - swapped score) ** 2 on the features that differ
            both = np.union1d(e.index, e.other_index)
            d = np.zeros(len(both))
            d[np.searchsorted(both, e.index)] += e.value
            d[np.searchsorted(both, e.other_index)] -= e.other_value
            both, d = both[d != 0], d[d != 0]
            w = self.weights(both)
            self._move(both, w, 2 * swap_penalty * d[:, None] * (d @ w)[None, :])

    def final(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights by feature and class, and the bias."""
        w = self.weights(np.arange(len(self.z)))
        return w[:-1], w[-1]


def probabilities(scores: np.ndarray) -> np.ndarray:
    scores = np.asarray(scores, float)
    if scores.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[Example], size: int, classes: int, epochs: int, seed: int = 7, swap_penalty: float = 0.0, importance: list[float] | None = None, **options) -> Ftrl:
    model, rng = Ftrl(size, classes, **options), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            model.learn(examples[i], importance[examples[i].label] if importance else 1.0, swap_penalty)
    return model


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = probabilities(scores / np.exp(t))
        q = np.where(labels == 1, p[:, 0], 1 - p[:, 0]) if p.shape[1] == 1 else p[np.arange(len(labels)), labels]
        return -np.log(np.clip(q, 1e-12, 1)).mean()

    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
