"""Gaussian mixtures whose component means may carry a Gaussian prior over the component index.

One Spark job per iteration: every task reduces its rows to sufficient statistics of the components with numpy, Spark sums
them by component, and only K * d (or K * d * d) numbers reach the driver, whatever the number of rows. The driver solves the
linear systems, banded ones under a prior. The objective of an iteration falls out of the next one's pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import priors

#: Volume, shape and orientation of the components' covariances, each equal, variable or (I) along the axes.
MODELS = ("EII", "VII", "EEI", "VEI", "EVI", "VVI", "EEE", "VEE", "EVE", "VVE", "EEV", "VEV", "EVV", "VVV")
FULL = tuple(m for m in MODELS if m[2] != "I")
RIDGE, LEAST_WEIGHT, LEAST_DENSITY = 1e-6, 1e-8, 1e-300


class Collapsed(ValueError):
    """A component's covariance isn't positive definite any more."""


@dataclass
class Params:
    """Weights (K), means (K, d) and covariances (K, d, d)."""

    pi: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    inverse: np.ndarray | None = field(default=None, repr=False)
    logdet: np.ndarray | None = field(default=None, repr=False)
    precision: np.ndarray | None = field(default=None, repr=False)  # inverse variances (K, d), if all covariances are diagonal

    @property
    def shape(self) -> tuple[int, int]:
        return self.mu.shape

    def cached(self) -> Params:
        """With inverses and log-determinants of the covariances; Collapsed if one isn't positive definite."""
        try:
            low = np.linalg.cholesky(self.sigma)
        except np.linalg.LinAlgError:
            raise Collapsed("a covariance isn't positive definite: a component has collapsed") from None
        inv, scale = np.linalg.inv(low), np.diagonal(low, axis1=1, axis2=2)
        plain = not (self.sigma * (1 - np.eye(self.sigma.shape[1]))).any()
        return replace(self, inverse=np.swapaxes(inv, 1, 2) @ inv, logdet=2 * np.log(scale).sum(axis=1), precision=scale**-2.0 if plain else None)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, float(self.pi[k]), self.mu[k].tolist(), self.sigma[k].tolist()) for k in range(len(self.pi))]
        return spark.createDataFrame(rows, "k int, pi double, mu array<double>, sigma array<array<double>>")


def isotropic(pi, mu, variance) -> Params:
    """Parameters with one diagonal covariance for all components."""
    mu = np.asarray(mu, float)
    v = np.broadcast_to(np.asarray(variance, float), mu.shape[1:])
    return Params(np.asarray(pi, float), mu, np.repeat(np.diag(v)[None], len(mu), axis=0))


def log_joint(x: np.ndarray, p: Params) -> np.ndarray:
    """log(pi_k) + log N(x_i | k), (rows, K)."""
    k, d = p.shape
    out = np.empty((len(x), k))
    with np.errstate(divide="ignore"):
        const = np.log(p.pi) - 0.5 * (p.logdet + d * np.log(2 * np.pi))
    for j in range(k):
        c = x - p.mu[j]
        out[:, j] = const[j] - 0.5 * (np.einsum("ij,ij->i", c @ p.inverse[j], c) if p.precision is None else (c * c) @ p.precision[j])
    return out


def responsibilities(x: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Rows' shares of the components, and the log of their mixture density."""
    lj = log_joint(x, p)
    top = lj.max(axis=1, keepdims=True)
    e = np.exp(lj - top)
    s = e.sum(axis=1, keepdims=True)
    return e / s, (top + np.log(s))[:, 0]


def rows_of(batch: pa.RecordBatch | pa.Array, column: str = "x") -> np.ndarray:
    lists = batch if isinstance(batch, pa.Array) else batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


@dataclass
class Statistics:
    """Sums over rows: n, weight (K), first (K, d), second (K, d, d) or its diagonals around each component's ``centre`` (K, d), and the two forms of the log-likelihood."""

    n: int
    weight: np.ndarray
    first: np.ndarray
    second: np.ndarray
    centre: np.ndarray
    loglik_added: float
    loglik_floored: float
    diagonal: bool

    def scatter(self, around: np.ndarray) -> np.ndarray:
        """Weighted scatter of each component around the given means: (K, d, d), or its diagonals (K, d)."""
        m = around - self.centre
        if self.diagonal:
            return self.second - 2 * m * self.first + self.weight[:, None] * m * m
        cross = m[:, :, None] * self.first[:, None, :]
        return self.second - cross - np.swapaxes(cross, 1, 2) + self.weight[:, None, None] * m[:, :, None] * m[:, None, :]

    def sums(self) -> np.ndarray:
        """Weighted sums of the rows themselves."""
        return self.first + self.weight[:, None] * self.centre


Weights = Callable[[np.ndarray, Params, pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def soft(x: np.ndarray, p: Params, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return responsibilities(x, p)


def statistics(data: DataFrame, params: Params, diagonal: bool, centre: np.ndarray | None = None, weights: Weights = soft, columns: tuple[str, ...] = ("x",)) -> Statistics:
    """One pass over ``data``; tasks send K * (1 + d + d or d * d) numbers each, which Spark sums by key.

    Sums stand around the components' present means unless ``centre`` is given: around one point far from a tight component,
    its scatter would be lost in rounding.
    """
    p, (k, d) = params.cached(), params.shape
    width = d if diagonal else d * d
    centre = np.broadcast_to(p.mu if centre is None else centre, (k, d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, extra = np.zeros((k, 1 + d + width)), np.zeros(3)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = rows_of(part)
                g, ll = weights(x, p, part)
                extra += (len(x), np.log(np.exp(ll) + LEAST_DENSITY).sum(), np.log(np.maximum(np.exp(ll), LEAST_DENSITY)).sum())
                acc[:, 0] += g.sum(axis=0)
                for j in range(k):
                    y, w = x - centre[j], g[:, j]
                    acc[j, 1 : 1 + d] += w @ y
                    acc[j, 1 + d :] += w @ (y * y) if diagonal else ((y * w[:, None]).T @ y).ravel()
        values = np.concatenate([acc.ravel(), extra])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "v"])

    sums = data.select(*columns).mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(k * (1 + d + width) + 3)
    for r in sums:
        v[r["at"]] = r["v"]
    a, extra = v[:-3].reshape(k, -1), v[-3:]
    second = a[:, 1 + d :] if diagonal else a[:, 1 + d :].reshape(k, d, d)
    return Statistics(int(extra[0]), a[:, 0], a[:, 1 : 1 + d], second, centre, float(extra[1]), float(extra[2]), diagonal)


def column_summary(data: DataFrame) -> dict[str, np.ndarray]:
    """Mean, population variance, least and largest of each feature, in one aggregation."""
    first = data.select("x").first()
    if first is None:
        raise ValueError("there are no rows")
    d = len(first["x"])
    x = [F.col("x")[j] for j in range(d)]
    r = data.agg(*[f(c) for c in x for f in (F.avg, F.var_pop, F.min, F.max)]).first()
    a = np.array(r, float).reshape(d, 4)
    return dict(zip(("mean", "variance", "least", "most"), a.T))


def drawn(*parts: object) -> float:
    """A number in 0..1 from the first 52 bits of the MD5 of the parts, joined by colons."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def default_start(data: DataFrame, k: int, seed: int = 1) -> Params:
    """Equal weights, means uniform in the box of the data, identity covariances. The same for the same seed."""
    box = column_summary(data)
    u = np.array([[drawn(seed, i + 1, j + 1) for j in range(len(box["least"]))] for i in range(k)])
    return isotropic(np.full(k, 1 / k), box["least"] + u * (box["most"] - box["least"]), 1.0)


def e_step(data: DataFrame, params: Params, name: str = "gamma") -> DataFrame:
    """data with the responsibilities of each row as an array."""
    return data.withColumn(name, responsibility_udf(params)(F.col("x")))


def responsibility_udf(params: Params):
    p = params.cached()

    @F.arrow_udf("array<double>")
    def gamma(x: pa.Array) -> pa.Array:
        g = responsibilities(rows_of(x), p)[0] if len(x) else np.zeros((0, len(p.pi)))
        return pa.FixedSizeListArray.from_arrays(pa.array(g.ravel()), len(p.pi)).cast(pa.list_(pa.float64()))

    return gamma


def e_step_expressions(x: Column, params: Params) -> Column:
    """The same as an expression of built-in functions, for diagonal covariances."""
    from ..functions.arrays import diagonal_log_density, logsumexp

    lj = F.array(*[F.lit(float(np.log(w))) + diagonal_log_density(x, m, np.diag(s)) for w, m, s in zip(params.pi, params.mu, params.sigma)])
    return F.transform(lj, lambda v: F.exp(v - logsumexp(lj)))


def covariances(stats: Statistics, means: np.ndarray, floored: np.ndarray, model: str) -> np.ndarray:
    """Maximum-likelihood covariances of the model around the means (Celeux & Govaert 1995); VVV and EEI carry a small ridge.

    EEV and VEV turn each scatter into its own axes, in order of size; VEE, EVE and VVE take turns until nothing changes.
    """
    k, d = means.shape
    s = stats.scatter(means)
    if model in FULL and not np.isfinite(s).all():
        raise Collapsed("a scatter isn't finite")
    if model in ("EEV", "VEV"):
        values, axes = np.linalg.eigh(s)
        values = np.maximum(values, 0)
        own = np.repeat((values.sum(axis=0) / stats.n)[None], k, axis=0) if model == "EEV" else equal_shape(values, floored)
        return rotated(own, axes)
    if model == "EVV":
        size = volumes(s)
        return s / size[:, None, None] * (size.sum() / stats.n)
    if model == "VEE":
        return equal_form(s, floored)
    if model in ("EVE", "VVE"):
        return equal_axes(s, floored, stats.n, model)
    if model == "VVV":
        return s / floored[:, None, None] + RIDGE * np.eye(d)
    if model == "EEE":
        return np.repeat((s.sum(axis=0) / stats.n)[None], k, axis=0)
    if model == "EEI":
        shared = np.repeat((s.sum(axis=0) / stats.n + RIDGE)[None], k, axis=0)
    elif model == "VVI":
        shared = s / floored[:, None]
    elif model == "EVI":
        size = np.exp(np.log(np.maximum(s, LEAST_DENSITY)).mean(axis=1, keepdims=True))
        shared = s / size * size.sum() / stats.n
    elif model == "VEI":
        shared = equal_shape(s, floored)
    elif model == "VII":
        shared = np.repeat((s.sum(axis=1) / (floored * d))[:, None], d, axis=1)
    elif model == "EII":
        shared = np.full((k, d), s.sum() / (floored.sum() * d))
    else:
        raise ValueError(f"no such covariance model: {model}; there are {', '.join(MODELS)}")
    return shared[:, :, None] * np.eye(d)


def equal_shape(s: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Variances volume_k * shape with one shape (product 1) for all, from diagonal scatters: volumes and shape in turns."""
    volume = s.mean(axis=1) / weight
    for _ in range(rounds):
        shape = (s / volume[:, None]).sum(axis=0)
        shape = shape / np.exp(np.log(np.maximum(shape, LEAST_DENSITY)).mean())
        new = (s / shape).mean(axis=1) / weight
        done = np.allclose(new, volume, rtol=1e-12, atol=0)
        volume = new
        if done:
            break
    return volume[:, None] * shape


def rotated(values: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Covariances from variances (K, d) along axes (K, d, d)."""
    return np.einsum("kij,kj,klj->kil", axes, values, axes)


def volumes(s: np.ndarray) -> np.ndarray:
    """|S| ** (1/d) of each scatter."""
    sign, log = np.linalg.slogdet(s)
    if (sign <= 0).any():
        raise Collapsed("a scatter is singular")
    return np.exp(log / s.shape[1])


def equal_form(s: np.ndarray, weight: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """volume_k times one form of determinant 1 for all: volumes and form in turns."""
    d = s.shape[1]
    volume = np.trace(s, axis1=1, axis2=2) / (d * weight)
    for _ in range(rounds):
        if (volume <= 0).any():
            raise Collapsed("a scatter is zero")
        form = (s / volume[:, None, None]).sum(axis=0)
        form = form / volumes(form[None])[0]
        new = np.einsum("kij,ji->k", s, np.linalg.inv(form)) / (d * weight)
        done = np.allclose(new, volume, rtol=1e-12, atol=0)
        volume = new
        if done:
            break
    return volume[:, None, None] * form


def equal_axes(s: np.ndarray, weight: np.ndarray, n: int, model: str, rounds: int = 5000, tol: float = 1e-11) -> np.ndarray:
    """Variances of each component along axes that all share.

    Given the axes, variances are those of the scatter along them. The axes then minimise the sum of tr(S_k D inv(V_k) D'): S_k less its largest eigenvalue
    is negative semidefinite, so the sum lies below its tangent there and the best rotation of the tangent is a singular value decomposition
    (majorisation as in Browne & McNicholas 2014).
    """
    k, d, _ = s.shape
    top = np.linalg.eigvalsh(s)[:, -1]
    axes = np.linalg.eigh(s.sum(axis=0))[1]

    def along(axes: np.ndarray) -> np.ndarray:
        v = np.maximum(np.einsum("ji,kjl,li->ki", axes, s, axes), LEAST_DENSITY)
        if model == "VVE":
            return v / weight[:, None]
        size = np.exp(np.log(v).mean(axis=1, keepdims=True))
        return v / size * (size.sum() / n)

    for _ in range(rounds):
        tangent = np.einsum("kij,jl,kl->il", top[:, None, None] * np.eye(d) - s, axes, 1 / along(axes))
        u, _, w = np.linalg.svd(tangent)
        moved = np.abs(u @ w - axes).max()
        axes = u @ w
        if moved < tol:
            break
    return rotated(along(axes), np.repeat(axes[None], k, axis=0))


Prior = np.ndarray | priors.Banded


def m_step(stats: Statistics, params: Params, prior: Prior | None = None, model: str = "VVV", mean_update: str = "weighted", cov_center: str = "unpenalised") -> Params:
    """New parameters from the statistics.

    ``weighted``: with a prior the means solve (blockdiag(N_k inv(S_k)) + Q) u = stack(inv(S_k) sum_k) under the previous
    covariances, and covariances stand around the means without prior, unless ``cov_center`` is ``penalised``.
    ``unweighted``: means solve (diag(N_k) + Q) u = stack(sum_k), and covariances stand around these means.
    """
    if model not in MODELS:
        raise ValueError(f"no such covariance model: {model}; there are {', '.join(MODELS)}")
    k, d = params.shape
    weight, sums = np.maximum(stats.weight, LEAST_WEIGHT), stats.sums()
    plain = sums / weight[:, None]
    if mean_update == "unweighted":
        if model == "EEI":
            raise ValueError("the unweighted update has no EEI covariances")
        means = priors.solved(prior, weight[:, None, None] * np.eye(d), sums) if prior is not None else plain
        return Params(weight / stats.n, means, covariances(stats, means, weight, model))
    means = plain
    if prior is not None:
        inverse = params.inverse if params.inverse is not None else params.cached().inverse
        means = priors.solved(prior, weight[:, None, None] * inverse, np.einsum("kij,kj->ki", inverse, sums))
    centre = means if cov_center == "penalised" else plain
    return Params(weight / stats.n, means, covariances(stats, centre, weight, model))


def objective(loglik: float, means: np.ndarray, prior: Prior | None, log_det: float | None = None) -> float:
    """Log-likelihood plus log prior density up to a constant; ``log_det`` is that of the prior, if it is known already."""
    if prior is None:
        return loglik
    u = means.ravel()
    return loglik - 0.5 * float(u @ (prior @ u)) + 0.5 * (priors.log_det(prior) if log_det is None else log_det)


@dataclass
class Fit:
    params: Params
    scoring: Params  # the parameters behind ``gamma``: those before the last update
    trace: list[float]
    converged: bool
    decreased: bool

    def gamma(self, data: DataFrame) -> DataFrame:
        """data with the responsibilities of the last E-step."""
        return e_step(data, self.scoring)

    def ordering(self, data: DataFrame) -> DataFrame:
        """id, k (most likely component, from 1), position."""
        from .ordering import by_component

        return by_component(self.gamma(data))

    def trace_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(self.trace)], "iter int, objective double")


def fit(data: DataFrame, start: Params, prior: Prior | None = None, model: str = "VVV", max_iter: int = 100, tol: float = 1e-4, mean_update: str = "weighted", cov_center: str = "unpenalised", late_params: bool = True) -> Fit:
    """Expectation-maximisation from ``start``.

    Stops when the objective gains less than ``tol``, which includes a loss (``decreased``). With ``late_params`` off, a
    converged run gives the parameters before its last update, like the unweighted variant it belongs to. The objective of
    iteration t comes out of the pass of iteration t + 1, so n iterations cost n + 1 passes.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be 1 at least")
    held = data.select("x").persist()
    try:
        diagonal, log_det = model not in FULL, None if prior is None else priors.log_det(prior)
        params = start.cached()
        stats = statistics(held, params, diagonal)
        trace: list[float] = []
        while True:
            new = m_step(stats, params, prior, model, mean_update, cov_center)
            if not np.isfinite(new.sigma).all():
                raise Collapsed("a covariance isn't finite: a component has collapsed")
            new = new.cached()
            stats = statistics(held, new, diagonal)
            trace.append(objective(stats.loglik_added, new.mu, prior, log_det))
            done = len(trace) > 1 and trace[-1] - trace[-2] < tol
            if done or len(trace) == max_iter:
                given = new if late_params or not done else params
                return Fit(given, params, trace, done, done and trace[-1] < trace[-2])
            params = new
    finally:
        held.unpersist()


def free_covariance(model: str, k: int, d: int) -> int:
    """Free numbers in the covariances: volumes, shapes of determinant 1, and rotations, once or for each component."""
    of = {"E": 1, "V": k, "I": 0}
    return of[model[0]] + of[model[1]] * (d - 1) + of[model[2]] * d * (d - 1) // 2


def bic(data: DataFrame, fitted: Fit, model: str) -> float:
    """2 log-likelihood minus parameters times log n: larger is better."""
    k, d = fitted.params.shape
    return 2 * fitted.trace[-1] - (free_covariance(model, k, d) + k * d + k - 1) * np.log(data.count())


def best_model(data: DataFrame, start: Params, models: tuple[str, ...] = MODELS, **options) -> tuple[str, Fit, dict[str, float]]:
    """The covariance model with the largest BIC; a model whose covariance collapses is left out."""
    fits, scores = {}, {}
    for m in models:
        try:
            fits[m] = fit(data, start, model=m, **options)
            scores[m] = bic(data, fits[m], m)
        except Collapsed:
            continue
    if not scores:
        raise Collapsed("every covariance model collapsed")
    best = max(scores, key=scores.__getitem__)
    return best, fits[best], scores
