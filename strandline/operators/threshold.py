"""Threshold EM: assign rows to components, hard or at random, then fit any smoother to the components' moments.

A smoother sees only n_k, the sums of x and of x squared of each component: rows at one location differ in nothing else that a
least-squares or Gaussian-process fit needs. So an iteration is one pass over the data and a small fit on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixture import Params, column_summary, drawn, isotropic, responsibilities, responsibility_udf, statistics


@dataclass
class Moments:
    n: np.ndarray  # (K)
    first: np.ndarray  # (K, d)
    second: np.ndarray  # (K, d)


class Smoother(Protocol):
    def __call__(self, moments: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights (K), means (K, d), and one variance for each dimension (d)."""


def uniforms(ids: list, seed: int, step: int) -> np.ndarray:
    """A number in 0..1 for each id, from a hash: it doesn't depend on partitions or order."""
    return np.array([drawn(seed, step, i) for i in ids])


def chosen(g: np.ndarray, u: np.ndarray | None) -> np.ndarray:
    """The first largest entry of each row, or the one that u falls on in the running sum."""
    if u is None:
        return g.argmax(axis=1)
    return np.minimum((np.cumsum(g, axis=1) < u[:, None]).sum(axis=1), g.shape[1] - 1)


def assign(data: DataFrame, params: Params, seed: int | None = None, step: int = 1) -> DataFrame:
    """id, k: the most likely component of each row, or with a seed one drawn by its responsibilities."""
    rows = data.select("id", responsibility_udf(params)("x").alias("g"))
    if seed is None:
        return rows.select("id", F.array_position("g", F.array_max("g")).cast("int").alias("k"))

    @F.arrow_udf("int")
    def pick(ids: pa.Array, g: pa.Array) -> pa.Array:
        p = g.flatten().to_numpy().reshape(len(g), -1)
        return pa.array(chosen(p, uniforms(ids.to_pylist(), seed, step)) + 1, pa.int32())

    return rows.select("id", pick("id", "g").alias("k"))


@dataclass
class ThresholdFit:
    params: Params
    trace: list[float]
    converged: bool


def fit_threshold(data: DataFrame, start: Params, smoother: Smoother, threshold: str = "hard", seed: int = 1, max_iter: int = 100, tol: float = 1e-4) -> ThresholdFit:
    """Iterate E-step, assignment and smoother; stops when the log-likelihood changes by less than ``tol``.

    The objective is the mixture log-likelihood under the parameters that the pass started from.
    """
    if threshold not in ("hard", "stochastic"):
        raise ValueError("threshold must be hard or stochastic")
    columns = ("x",) if threshold == "hard" else ("x", "id")
    held = data.select(*columns).persist()
    try:
        centre = column_summary(held)["mean"]
        params, trace = start, []
        for step in range(1, max_iter + 1):

            def weights(x: np.ndarray, p: Params, batch: pa.RecordBatch, step: int = step) -> tuple[np.ndarray, np.ndarray]:
                g, ll = responsibilities(x, p)
                u = uniforms(batch.column("id").to_pylist(), seed, step) if threshold == "stochastic" else None
                return np.eye(g.shape[1])[chosen(g, u)], ll

            s = statistics(held, params, True, centre, weights, columns)
            trace.append(s.loglik_added)
            if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol:
                return ThresholdFit(params, trace, True)
            zero = np.zeros_like(centre)
            pi, mu, variance = smoother(Moments(s.weight, s.sums(), s.scatter(np.repeat(zero[None], len(s.weight), axis=0))))
            params = isotropic(pi, mu, np.maximum(variance, 1e-12))
        return ThresholdFit(params, trace, False)
    finally:
        held.unpersist()
