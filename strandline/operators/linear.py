"""Mixture whose means lie on a line: mu_k = t_k * beta, with a Gaussian prior on the slope."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .mixture import LEAST_WEIGHT, RIDGE, Fit, Params, column_summary, isotropic, statistics

EXTRA_RIDGE = 1e-8


def solve_slope(t: np.ndarray, weight: np.ndarray, sums: np.ndarray, precision: float, inverse: np.ndarray) -> np.ndarray:
    """Slope from (p I + sum N_k t_k^2 inv(S_k)) beta = sum t_k inv(S_k) sum_k."""
    left = precision * np.eye(sums.shape[1]) + np.einsum("k,kij->ij", weight * t**2, inverse)
    return np.linalg.solve(left, np.einsum("k,kij,kj->i", t, inverse, sums))


@dataclass
class LinearFit(Fit):
    slope: np.ndarray
    grid: np.ndarray


def fit_linear(data: DataFrame, k: int, precision: float = 1.0, grid: np.ndarray | None = None, seed: int = 1, slope: np.ndarray | None = None, sigma: np.ndarray | None = None, max_iter: int = 100, tol: float = 1e-4) -> LinearFit:
    """Centred data; the start's slope is standard normal by ``seed`` unless given. One shared diagonal covariance.

    A non-finite objective warns and ends the run without a trace entry. The means come back uncentred, the slope as it is.
    """
    held = data.select("x").persist()
    try:
        summary = column_summary(held)
        mean = summary["mean"]
        d = len(mean)
        t = np.linspace(-1, 1, k) if grid is None else np.asarray(grid, float)
        beta = np.random.default_rng(seed).standard_normal(d) if slope is None else np.asarray(slope, float)
        around = lambda b: mean + t[:, None] * b
        params = isotropic(np.full(k, 1 / k), around(beta), 1.0)
        if sigma is not None:
            params.sigma = np.asarray(sigma, float)
        params = params.cached()
        stats = statistics(held, params, True, mean)
        trace: list[float] = []
        done = False
        for _ in range(max_iter):
            weight = np.maximum(stats.weight, LEAST_WEIGHT)
            # The weighted mean of a floored component times its floored weight is the plain weighted sum.
            beta = solve_slope(t, weight, stats.first, precision, params.inverse)
            v = stats.scatter(around(beta)).sum(axis=0) / stats.n + RIDGE + EXTRA_RIDGE
            new = isotropic(weight / stats.n, around(beta), v).cached()
            stats = statistics(held, new, True, mean)
            value = stats.loglik_floored - 0.5 * precision * float(beta @ beta)
            before, params = params, new
            if not math.isfinite(value):
                warnings.warn("the objective isn't finite; stopping early", stacklevel=2)
                break
            trace.append(value)
            done = len(trace) > 1 and trace[-1] - trace[-2] < tol
            if done:
                break
        return LinearFit(params, before, trace, done, done and trace[-1] < trace[-2], beta, t)
    finally:
        held.unpersist()
