"""Small boosted trees for tables that fit a task: logistic loss, complete trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, DEPTH, RATE, LEAST, PENALTY = 40, 3, 0.2, 8, 1.0


@dataclass
class Trees:
    """``feature`` and ``cut`` (trees x inner nodes, in level order), ``leaf`` (trees x leaves), and the calibration."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    thresholds: list[float] = field(default_factory=list)  # by kind, where the caller has kinds

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _best_split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """Feature and cut with the largest gain; without one everything goes left."""
    best, choice = 1e-9, (0, np.inf)
    total_g, total_w = gradient.sum(), weight.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        g, w = np.cumsum(gradient[order])[:-1], np.cumsum(weight[order])[:-1]
        count = np.arange(1, len(v))
        fit = (v[1:] > v[:-1]) & (count >= LEAST) & (len(v) - count >= LEAST)
        if not fit.any():
            continue
        gain = g**2 / (w + PENALTY) + (total_g - g) ** 2 / (total_w - w + PENALTY) - total_g**2 / (total_w + PENALTY)
        k = int(np.argmax(np.where(fit, gain, -np.inf)))
        if gain[k] > best:
            best, choice = gain[k], (f, (v[k] + v[k + 1]) / 2)
    return choice


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = Trees(
        float(np.log(share / (1 - share))), np.zeros((TREES, inner), int), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    )
    z = np.full(len(x), model.start)
    for t in range(TREES):
        p = _sigmoid(z)
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(x), int)
        for level in range(DEPTH):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = node == n
                if rows.sum() >= 2 * LEAST:
                    model.feature[t, n], model.cut[t, n] = _best_split(x[rows], gradient[rows], weight[rows])
            node = 2 * node + 1 + (x[np.arange(len(x)), model.feature[t][node]] > model.cut[t][node])
        place = node - inner
        top = np.bincount(place, gradient, leaves)
        model.leaf[t] = RATE * top / (np.bincount(place, weight, leaves) + PENALTY)
        z += model.leaf[t][place]
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, precision: float) -> None:
    """Platt scaling on rows not fitted on, and the least threshold that has ``precision`` on them.

    Without rows of both kinds the threshold stays above 1, so that nothing is selected.
    """
    if y.min(initial=1) == y.max(initial=0):
        return
    z = model.raw(x)
    a, b = 1.0, 0.0
    # Platt's targets: a few rows are no proof of certainty.
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((goal - p) * z).sum() - 1e-3 * (a - 1), (goal - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    model.threshold = least_threshold(model.probability(x), y, precision, model.threshold)


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float, otherwise: float) -> float:
    """The least score, 0.5 at least, from which on ``precision`` of the rows are right; ``otherwise`` if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)  # no cut between equal scores
    good = np.flatnonzero((right >= precision) & last[: len(right)])
    return float(max(0.5, p[order][good[-1]])) if len(good) else otherwise
