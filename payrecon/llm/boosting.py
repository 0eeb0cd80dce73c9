"""A small gradient boosting of regression trees for a bounded table of numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right, value) rows; a leaf has feature -1."""

    bias: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            table = np.array(tree)
            for _ in range(8):
                feature = table[at, 0].astype(int)
                inner = feature >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(feature, 0)] <= table[at, 1]
                at = np.where(inner, np.where(low, table[at, 2], table[at, 3]).astype(int), at)
            out += table[at, 4]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> list:
    nodes: list = []

    def split(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append(None)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0.0)
        if left and len(rows) >= 4:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 16), method="lower")):
                    low = v <= cut
                    if low.all():
                        continue
                    gl, hl = g[rows][low].sum(), h[rows][low].sum()
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] < 0:
            nodes[me] = (-1, 0.0, 0, 0, float(-rate * gs / (hs + 1)))
        else:
            low = x[rows, best[1]] <= best[2]
            a = split(rows[low], left - 1)
            b = split(rows[~low], left - 1)
            nodes[me] = (best[1], best[2], a, b, 0.0)
        return me

    split(np.arange(len(x)), depth)
    return nodes


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Trees on the logistic loss, by second-order gains over quantile cuts."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    score = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), depth, rate)
        model.trees.append(tree)
        score += Boosted(0.0, [tree]).raw(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> None:
    """Platt's scale on held-out rows, and the least threshold that keeps `precision` there (2: none does)."""
    s = model.raw(x)
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        a, b = a - 0.5 * float(((p - goal) * s).mean()) / max(1.0, float((s * s).mean())), b - 0.5 * float((p - goal).mean())
    model.scale = (max(a, 1e-3), b)
    model.threshold = least_threshold(model.probability(x), y, precision)


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability, 0.5 at least, from which on `precision` of the rows are right; 2 if there is none. It is
    half way from the last row that counts to the next one."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return 2.0
    ranked = np.append(p[order], 0.0)
    return max(0.5, float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2)
