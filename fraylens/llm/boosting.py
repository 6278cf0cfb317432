"""Gradient-boosted oblivious trees, isotonic calibration, and their form as SQL expressions.

A model is fitted on a bounded sample of labelled rows (the caller's documented limit) and is a few kilobytes. Every level of a tree asks
one question of all rows, so a tree is ``depth`` comparisons and a table of ``2 ** depth`` values: cheap in numpy and in SQL alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    base: float
    trees: list[tuple[list[int], list[float], list[float]]] = field(default_factory=list)
    steps: tuple[list[float], list[float]] = ((0.0,), (0.5,))  # margins and calibrated probabilities, both rising

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            leaf = np.zeros(len(x), "i8")
            for k, (f, t) in enumerate(zip(features, cuts)):
                leaf += (x[:, f] > t).astype("i8") << k
            out += np.asarray(leaves)[leaf]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; 2 % of the raw probability keeps the order within a calibrated step."""
        m = self.margin(x)
        return 0.98 * np.interp(m, *self.steps) + 0.02 / (1 + np.exp(-m))

    def margin_column(self, columns: list[Column]) -> Column:
        """The margin of non-null numeric columns."""
        out = F.lit(float(self.base))
        for features, cuts, leaves in self.trees:
            leaf = F.lit(1)
            for k, (f, t) in enumerate(zip(features, cuts)):
                leaf = leaf + F.when(columns[f] > F.lit(float(t)), 1 << k).otherwise(0)
            out = out + F.element_at(F.array(*[F.lit(float(v)) for v in leaves]), leaf)
        return out

    def probability_column(self, margin: Column) -> Column:
        """Same as ``probability``, of a margin column."""
        xs, ys = ([float(v) for v in s] for s in self.steps)
        out = F.lit(ys[-1])
        for i in range(len(xs) - 2, -1, -1):
            slope = (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])
            out = F.when(margin < xs[i + 1], F.lit(ys[i]) + (margin - xs[i]) * slope).otherwise(out)
        out = F.when(margin < xs[0], ys[0]).otherwise(out)
        return 0.98 * out + 0.02 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Logistic loss, second-order gains, quantile cuts. One class or no rows: a constant."""
    x, y = np.asarray(x, "f8"), np.asarray(y, "f8")
    p = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    model = Boosted(float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        model.steps = ([model.base], [p])
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    width = max(len(c) for c in cuts) + 1
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)  # number of cuts below the value
    margin = np.full(len(y), model.base)
    columns = np.arange(x.shape[1])
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        leaf, chosen, thresholds = np.zeros(len(y), "i8"), [], []
        for level in range(depth):
            slot = (leaf[:, None] * len(columns) + columns) * width + code
            size = (1 << level) * len(columns) * width
            sums = [np.bincount(slot.ravel(), np.repeat(v, len(columns)), size).reshape(-1, len(columns), width).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = ([s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums])
            gain = (gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)).sum(0)
            for f, c in enumerate(cuts):
                gain[f, len(c):] = -1
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] <= 1e-9:
                break
            chosen.append(int(f)), thresholds.append(float(cuts[f][b]))
            leaf += (code[:, f] > b).astype("i8") << level
        if not chosen:
            break
        n = 1 << len(chosen)
        values = rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + l2)
        model.trees.append((chosen, thresholds, values.tolist()))
        margin += values[leaf]
    model.steps = ([-8.0, 8.0], [1 / (1 + np.exp(8.0)), 1 / (1 + np.exp(-8.0))])
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, least: int = 10) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators steps of the label's mean, as points to interpolate between; each pools ``least`` rows at least."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of margins, rows
    for m, v in zip(margin[order].tolist(), np.asarray(y, "f8")[order].tolist()):
        blocks.append([v, m, 1])
        while len(blocks) > 1 and (blocks[-2][2] < least or blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    xs = [b[1] / b[2] for b in blocks]
    ys = [(b[0] + 0.5 * 0.1) / (b[2] + 0.1) for b in blocks]
    keep = [i for i in range(len(xs)) if i == 0 or xs[i] > xs[i - 1] + 1e-9]
    return [xs[i] for i in keep], np.maximum.accumulate([ys[i] for i in keep]).tolist()


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: np.ndarray, **settings) -> Boosted:
    """Calibrates on margins of rows that each fold's model hasn't seen; the final trees see all rows."""
    model = fit(x, y, **settings)
    if len(y) < 20 or min(y.sum(), len(y) - y.sum()) < 5:
        return model
    margin, seen = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in np.unique(folds):
        out = folds == k
        if 0 < y[~out].sum() < (~out).sum():
            margin[out] = fit(x[~out], y[~out], **settings).margin(x[out])
            seen |= out
    if seen.any() and 0 < y[seen].sum() < seen.sum():
        model.steps = isotonic(margin[seen], y[seen])
    return model
