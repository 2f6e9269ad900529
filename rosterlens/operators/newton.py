"""Class-balanced logistic models of many targets, fitted together by Newton's method.

Every iteration is one scan for all targets: a task multiplies its rows' features out once for each target, with that
target's weights, and Spark adds up gradients and Hessians.  The number of jobs is that of the slowest target's
iterations and does not grow with the targets.

Rows carry one common feature vector.  A target whose rows have other means and deviations is penalised as if its
features were standardised on its own rows: that is a diagonal change of the penalty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sums import matrix, packed, square, summed, triangle

TOLERANCE, MOST_STEPS = 1e-9, 50


@dataclass(frozen=True)
class Moments:
    """Of one target's train rows: number, number of class 1, and mean and population deviation by feature."""

    n: int
    ones: int
    mean: np.ndarray
    std: np.ndarray

    def class_weights(self) -> tuple[float, float]:
        return self.n / (2.0 * (self.n - self.ones)), self.n / (2.0 * self.ones)


@dataclass(frozen=True)
class Fit:
    intercept: float
    coefficients: np.ndarray  # of the common features
    steps: int
    objective: float


def target_moments(rows: DataFrame, features: int, targets: int) -> list[Moments]:
    """One scan over rows of (x, y): ``y`` has a number for each target, null where the row is not used."""
    size = 2 + 2 * features

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(batch.column(0), features), matrix(batch.column(1), targets)
        used = ~np.isnan(y)
        sums = [used.sum(axis=0), np.nansum(y, axis=0)]
        u = used.astype(float)
        return np.concatenate([np.stack(sums, axis=1), u.T @ x, u.T @ (x * x)], axis=1).ravel()

    out = []
    for v in summed(rows, targets * size, part).reshape(targets, size):
        n, mean = v[0], v[2 : 2 + features] / max(v[0], 1)
        spread = np.maximum(v[2 + features :] / max(n, 1) - mean**2, 0.0)
        spread[spread < 1e-12 * np.maximum(mean**2, 1.0)] = 0.0
        out.append(Moments(int(n), int(v[1]), mean, np.sqrt(spread)))
    return out


def fit_targets(
    rows: DataFrame,
    features: int,
    moments: Sequence[Moments],
    standardised: int = 0,
    c: float = 1.0,
    max_steps: int = MOST_STEPS,
    tolerance: float = TOLERANCE,
    live: Sequence[np.ndarray] | None = None,
) -> list[Fit | None]:
    """A model for each target of rows of (x, y), see ``target_moments``; None where there is only one class.

    The first ``standardised`` features are penalised by their deviation among the target's rows.  Features outside
    ``live`` (or without any spread) have coefficient 0.  The objective is half the squared coefficients plus ``c``
    times the weighted log loss; the intercept is not penalised.  A step that does not improve it is halved.
    """
    targets, d = len(moments), features + 1
    one_class = [m.ones in (0, m.n) for m in moments]
    beta = np.zeros((targets, d))
    scale = np.ones((targets, d))
    on = np.ones((targets, d), bool)
    for t, m in enumerate(moments):
        scale[t, 1 : 1 + standardised] = m.std[:standardised]
        on[t, 1:] = m.std > 0
        if live is not None:
            on[t, 1:] &= live[t]
    penalty = scale**2
    penalty[:, 0] = 0.0
    weights = np.array([(1.0, 1.0) if dull else m.class_weights() for m, dull in zip(moments, one_class)])
    best = beta.copy()
    reached = np.full(targets, np.inf)
    step = np.zeros((targets, d))
    steps = np.zeros(targets, int)
    todo = [t for t in range(targets) if not one_class[t]]
    size = 1 + d + triangle(d)

    def scan(which: list[int], at: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = matrix(batch.column(0), features)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            y = matrix(batch.column(1), targets)[:, which]
            m = x @ at.T
            used = ~np.isnan(y)
            y = np.where(used, y, 0.0)
            w = np.where(used, np.where(y > 0, weights[which, 1], weights[which, 0]), 0.0)
            p = 1.0 / (1.0 + np.exp(-m))
            loss = (w * (np.logaddexp(0.0, m) - y * m)).sum(axis=0)
            slope, bend = (w * (p - y)).T @ x, w * p * (1 - p)
            each = [np.concatenate([[loss[i]], slope[i], packed((x * bend[:, [i]]).T @ x)]) for i in range(len(which))]
            return np.concatenate(each)

        return summed(rows, len(which) * size, part).reshape(len(which), size)

    while todo:
        sums = scan(todo, beta[todo])
        left = []
        for t, v in zip(todo, sums):
            value = 0.5 * float(penalty[t] @ beta[t] ** 2) + c * v[0]
            steps[t] += 1
            if value > reached[t] + 1e-9 * abs(reached[t]):
                step[t] /= 2  # too far: back to the best point, half the way
                beta[t] = best[t] + step[t]
                if steps[t] < max_steps:
                    left.append(t)
                continue
            best[t], reached[t] = beta[t], value
            o = on[t]
            slope = c * v[1 : 1 + d] + penalty[t] * beta[t]
            bend = c * square(v[1 + d :], d) + np.diag(penalty[t])
            step[t] = 0.0
            step[t, o] = -np.linalg.lstsq(bend[np.ix_(o, o)], slope[o], rcond=1e-14)[0]
            done = np.abs(step[t] * scale[t]).max() < tolerance
            beta[t] = best[t] + step[t]
            if not done and steps[t] < max_steps:
                left.append(t)
            elif done:
                best[t] = beta[t]
        todo = left
    return [
        None if one_class[t] else Fit(float(best[t, 0]), best[t, 1:].copy(), int(steps[t]), float(reached[t])) for t in range(targets)
    ]
