"""Least-squares gradient boosting over binned features, with trees that grow best leaf first.

A fitted model is a row of plain arrays (``SCHEMA``), so that it can be kept as a table and
joined by whatever predicts with it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: The columns of a model: the base value, the first node of each tree, and by node its feature
#: (-1: a leaf), its cut (a value above it goes right), its children and its value.
SCHEMA = "base double, roots array<int>, feature array<int>, cut array<double>, child_left array<int>, child_right array<int>, leaf array<double>"
COLUMNS = ("base", "roots", "feature", "cut", "child_left", "child_right", "leaf")


@dataclass
class Model:
    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child_left: np.ndarray
    child_right: np.ndarray
    leaf: np.ndarray

    @classmethod
    def of(cls, row) -> "Model":
        """The model of a row (anything with the columns of ``SCHEMA`` by name)."""
        kinds = {"cut": float, "leaf": float}
        return cls(float(row["base"]), *(np.asarray(row[c], kinds.get(c, np.int64)) for c in COLUMNS[1:]))

    def row(self) -> dict:
        return {"base": self.base, **{c: getattr(self, c).tolist() for c in COLUMNS[1:]}}

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                right = x[rows, np.maximum(self.feature[node], 0)] > self.cut[node]
                node = np.where(inner, np.where(right, self.child_right[node], self.child_left[node]), node)
            out += self.leaf[node]
        return out


class Boosted:
    """``trees`` trees of at most ``leaves`` leaves, each with at least ``least`` rows and at most
    ``depth`` splits above it (None: any number). The leaf whose split gains most is split next;
    the histogram of the smaller child is counted and its sibling's is the parent's less that."""

    def __init__(self, trees: int = 100, leaves: int = 32, depth: int | None = 5, rate: float = 0.1, bins: int = 64, penalty: float = 1.0, least: int = 1) -> None:
        self.trees, self.leaves, self.depth, self.rate, self.bins, self.penalty, self.least = trees, leaves, depth, rate, bins, penalty, least

    def _best(self, hist: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, bin) of the best cut of a node with histogram (2, features, bins)."""
        n, g = hist.cumsum(2)
        total_n, total_g = n[:, -1:], g[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / (n + self.penalty) + (total_g - g) ** 2 / (total_n - n + self.penalty) - total_g**2 / (total_n + self.penalty)
        gain = np.where((n >= self.least) & (total_n - n >= self.least), gain, -np.inf)
        at = int(gain.argmax())
        return float(gain.flat[at]), *divmod(at, hist.shape[2])

    def _tree(self, b: np.ndarray, keys: np.ndarray, residual: np.ndarray, node: np.ndarray) -> list[list]:
        """Nodes (feature, bin, left, right, value) in order of their making; leaves each row's last node in ``node``."""
        width = b.shape[1]

        def histogram(rows: np.ndarray) -> np.ndarray:
            flat = keys[rows].ravel()
            counted = [np.bincount(flat, w, width * self.bins) for w in (None, np.repeat(residual[rows], width))]
            return np.stack(counted).reshape(2, width, self.bins)

        made, heap = [], []

        def grow(rows: np.ndarray, hist: np.ndarray, level: int) -> int:
            at, n = len(made), len(rows)
            node[rows] = at
            made.append([-1, 0, -1, -1, self.rate * float(residual[rows].sum()) / (n + self.penalty)])
            if n >= 2 * self.least and (self.depth is None or level < self.depth):
                gain, feature, k = self._best(hist)
                if gain > 1e-12:
                    heapq.heappush(heap, (-gain, at, feature, k, rows, hist, level))
            return at

        everything = np.arange(len(b))
        grow(everything, histogram(everything), 0)
        leaves = 1
        while heap and leaves < self.leaves:
            _, at, feature, k, rows, hist, level = heapq.heappop(heap)
            right = b[rows, feature] > k
            sides = rows[~right], rows[right]
            small = int(len(sides[1]) < len(sides[0]))
            counted = histogram(sides[small])
            hists = (hist - counted, counted) if small else (counted, hist - counted)
            made[at][:4] = feature, k, *(grow(side, h, level + 1) for side, h in zip(sides, hists))
            leaves += 1
        return made

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        """ValueError for no rows and for values that aren't finite."""
        if not len(y) or not np.isfinite(x).all() or not np.isfinite(y).all():
            raise ValueError("boosting needs rows of finite values")
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        keys = b + self.bins * np.arange(x.shape[1])
        base = float(y.mean())
        residual, node, roots, nodes = y - base, np.zeros(len(y), int), [], []
        for _ in range(self.trees):
            start = len(nodes)
            roots.append(start)
            made = self._tree(b, keys, residual, node)
            value = np.array([m[4] for m in made])
            residual = residual - value[node]
            nodes += [(f, edges[f][k] if f >= 0 else 0.0, lo + start, hi + start, v) for f, k, lo, hi, v in made]
        feature, cut, lo, hi, value = (np.array(c) for c in zip(*nodes))
        return Model(base, np.array(roots), feature.astype(int), cut.astype(float), lo.astype(int), hi.astype(int), value.astype(float))
