"""Logistic regression on a bounded sample, by Newton's method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    @classmethod
    def blank(cls, width: int) -> Logistic:
        return cls(np.zeros(width), np.ones(width), np.zeros(width + 1))

    @classmethod
    def constant(cls, width: int, chance: float) -> Logistic:
        model = cls.blank(width)
        model.weights[-1] = 30.0 if chance >= 0.5 else -30.0
        return model

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        weights = np.zeros(design.shape[1])
        ridge = np.diag([penalty] * x.shape[1] + [1e-6])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            slope = design.T @ (p - y) + ridge @ weights
            bend = (design * (p * (1 - p))[:, None]).T @ design + ridge
            step = np.linalg.solve(bend, slope)
            weights -= step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, weights)

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
