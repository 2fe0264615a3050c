"""A small random forest: bootstrap samples, a few features per split, Gini impurity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    # Per tree: feature (-1 in a leaf), threshold, left and right child, share of positives.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 10, least: int = 3, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([_tree(x[rows], y[rows], rng, depth, least) for rows in rng.integers(0, len(x), (trees, len(x)))])

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                rows = np.flatnonzero(inner)
                at = node[rows]
                goes_left = x[rows, feature[at]] <= threshold[at]
                node[rows] = np.where(goes_left, left[at], right[at])
            total += share[node]
        return total / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    rows: list[list] = []

    def grow(at: np.ndarray, level: int) -> int:
        me = len(rows)
        share = float(y[at].mean())
        rows.append([-1, 0.0, 0, 0, share])
        if level == depth or len(at) < 2 * least or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) - 1e-9, -1, 0.0)
        for feature in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5) + 1)]:
            order = np.argsort(x[at, feature], kind="stable")
            values, ones = x[at[order], feature], np.cumsum(y[at[order]])
            cut = np.flatnonzero(values[1:] > values[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(at) - least)]
            if not len(cut):
                continue
            low, high = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(at) - cut)
            impurity = (cut * low * (1 - low) + (len(at) - cut) * high * (1 - high)) / len(at)
            k = int(impurity.argmin())
            if impurity[k] < best[0]:
                # The lower value, not the middle: that may round to the upper one and leave a side empty.
                best = (float(impurity[k]), int(feature), float(values[cut[k] - 1]))
        if best[1] >= 0:
            goes_left = x[at, best[1]] <= best[2]
            rows[me][0], rows[me][1] = best[1], best[2]
            rows[me][2] = grow(at[goes_left], level + 1)
            rows[me][3] = grow(at[~goes_left], level + 1)
        return me

    grow(np.arange(len(x)), 0)
    return tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.int64, float, np.int64, np.int64, float)))
