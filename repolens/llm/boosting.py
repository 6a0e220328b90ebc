"""Gradient-boosted trees for few small-integer features: trained in numpy on the driver, applied as a Column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0  # rows with feature <= cut go to low
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int) -> Node:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    node, best = Node(value=float(-total_g / (total_h + 1.0))), 1e-6
    if depth == 0 or len(rows) < 2 * least:
        return node
    whole = total_g**2 / (total_h + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for a, b in zip(values[:-1], values[1:]):
            low = x[rows, f] <= (a + b) / 2
            n = int(low.sum())
            if least <= n <= len(rows) - least:
                lg, lh = g[rows][low].sum(), h[rows][low].sum()
                gain = lg**2 / (lh + 1.0) + (total_g - lg) ** 2 / (total_h - lh + 1.0) - whole
                if gain > best:
                    best, node.feature, node.cut = gain, f, float((a + b) / 2)
    if node.feature >= 0:
        low = x[rows, node.feature] <= node.cut
        node.low, node.high = (_grow(x, g, h, r, depth - 1, least) for r in (rows[low], rows[~low]))
    return node


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None or node.high is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(_apply(t, x) for t in self.trees)

    def raw_column(self, features: list[Column]) -> Column:
        def of(node: Node) -> Column:
            if node.low is None or node.high is None:
                return F.lit(node.value * self.rate)
            return F.when(features[node.feature] <= node.cut, of(node.low)).otherwise(of(node.high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + of(tree)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4, least: int = 8) -> Boosted:
    """Logistic loss, second-order steps."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    raw, rows = np.full(len(y), model.base), np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, p - y, p * (1 - p), rows, depth, least)
        model.trees.append(tree)
        raw += rate * _apply(tree, x)
    return model


def calibrate(raw: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least cut on the raw score above which at least this part of the rows is positive; infinite if there is none."""
    order = np.argsort(-raw, kind="stable")
    kept = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(raw[order][1:] != raw[order][:-1], True)
    good = np.flatnonzero((kept >= precision) & ends)
    if not len(good):
        return float("inf")
    k = good[-1]
    return float((raw[order][k] + raw[order][k + 1]) / 2 if k + 1 < len(y) else raw[order][k] - 1)
