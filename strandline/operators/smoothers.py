"""Smoothers for threshold EM: component means, penalised B-splines (Eilers & Marx 1996), integrated Wiener processes (Wahba 1978).

Each returns (pi, mu, variance); pi is constant, 1/K unless given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .threshold import Moments


def _weights(k: int, pi) -> np.ndarray:
    if pi is None:
        return np.full(k, 1 / k)
    if len(pi) != k:
        raise ValueError("pi must have one weight for each component")
    return np.asarray(pi, float)


def residual_variance(m: Moments, fitted: np.ndarray) -> np.ndarray:
    """Sample variance of the residuals in each dimension."""
    n = m.n.sum()
    total = (m.second - 2 * fitted * m.first + m.n[:, None] * fitted**2).sum(axis=0)
    mean = (m.first - m.n[:, None] * fitted).sum(axis=0) / n
    return (total - n * mean**2) / max(1, n - 1)


def group_means(k: int, pi=None):
    """No smoothing: each component's mean, and the overall mean for an empty one."""
    w = _weights(k, pi)

    def smooth(m: Moments):
        overall = m.first.sum(axis=0) / m.n.sum()
        mu = np.where(m.n[:, None] > 0, m.first / np.maximum(m.n, 1)[:, None], overall)
        return w, mu, residual_variance(m, mu)

    return smooth


def spline_basis(t: np.ndarray, count: int, degree: int = 3) -> np.ndarray:
    """B-splines on equal knots over the range of t, by the Cox-de Boor recursion: (len(t), count)."""
    inner = count - degree
    if inner < 1:
        raise ValueError(f"a spline of degree {degree} needs {degree + 1} basis functions at least")
    lo, hi = float(t.min()), float(t.max())
    h = (hi - lo) / inner or 1.0
    knots = lo + h * np.arange(-degree, inner + degree + 1)
    u = np.clip(t, lo, hi - 1e-12 * h)
    b = ((u[:, None] >= knots[:-1]) & (u[:, None] < knots[1:])).astype(float)
    for p in range(1, degree + 1):
        left = (u[:, None] - knots[: -p - 1]) / (p * h)
        right = (knots[p + 1 :] - u[:, None]) / (p * h)
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


@dataclass
class Fitted:
    """A penalised fit of one dimension: log marginal likelihood (noise profiled out, unpenalised part flat), its derivatives by the logs of the weights, the next weights."""

    coef: np.ndarray
    value: float
    slope: np.ndarray
    following: np.ndarray


def penalised_fit(m: Moments, j: int, b: np.ndarray, penalties: list[np.ndarray], smoothing: np.ndarray) -> Fitted:
    """``following`` is the update of Wood & Fasiolo (2017): where it changes nothing, the derivatives are 0."""
    gram = (b * m.n[:, None]).T @ b
    whole = sum(s * p for s, p in zip(smoothing, penalties))
    system = gram + whole + 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram))
    rhs = b.T @ m.first[:, j]
    coef = np.linalg.solve(system, rhs)
    values, vectors = np.linalg.eigh(sum(p / np.trace(p) for p in penalties))
    vectors = vectors[:, values > 1e-10 * values.max()]  # of what is penalised at all
    rank = vectors.shape[1]
    within, log_det = np.linalg.inv(vectors.T @ whole @ vectors), np.linalg.slogdet(vectors.T @ whole @ vectors)[1]
    free = m.n.sum() - (len(gram) - rank)
    rss = max(1e-300, m.second[:, j].sum() - rhs @ coef)
    value = -0.5 * free * math.log(rss) - 0.5 * np.linalg.slogdet(system)[1] + 0.5 * log_det
    inverse = np.linalg.inv(system)
    gain = np.array([s * (np.trace(within @ vectors.T @ p @ vectors) - np.trace(inverse @ p)) for s, p in zip(smoothing, penalties)])
    rough = np.array([max(1e-300, coef @ p @ coef) for p in penalties]) * free / rss
    return Fitted(coef, float(value), 0.5 * (gain - smoothing * rough), np.maximum(gain, 1e-300) / rough)


#: Weights between which the most likely one is looked for.
LEAST_WEIGHT, MOST_WEIGHT = 1e-8, 1e12


def most_likely(m: Moments, j: int, b: np.ndarray, penalties: list[np.ndarray], rounds: int = 1000, tol: float = 1e-9) -> Fitted:
    """The fit at the weights of largest marginal likelihood: from the best of a few, by updates of the weights until they stay.

    A single weight ends by halving a bracket of the derivative's change of sign, as updates alone come near it slowly.
    """
    fit = lambda s: penalised_fit(m, j, b, penalties, s)
    weights = max((np.full(len(penalties), 10.0**e) for e in range(-6, 11, 2)), key=lambda s: fit(s).value)
    if len(penalties) == 1:
        low, high = np.log(np.maximum(weights / 100, LEAST_WEIGHT)), np.log(np.minimum(weights * 100, MOST_WEIGHT))
        if fit(np.exp(low)).slope[0] > 0 > fit(np.exp(high)).slope[0]:
            while high[0] - low[0] > tol:
                mid = (low + high) / 2
                low, high = (mid, high) if fit(np.exp(mid)).slope[0] > 0 else (low, mid)
            return fit(np.exp((low + high) / 2))
    for _ in range(rounds):
        got = fit(weights)
        new = np.clip(got.following, LEAST_WEIGHT, MOST_WEIGHT)
        done = np.abs(np.log(new / weights)).max() < tol
        weights = new
        if done:
            break
    return fit(weights)


def penalised_spline(k: int, pi=None, count: int | None = None, locations=None, degree: int = 3, order: int | tuple[int, ...] = 2, smoothing: float | tuple[float, ...] | None = None):
    """Penalised B-spline over the locations (0..1): ``smoothing`` weighs squared differences of ``order`` of the coefficients; several orders have a weight each.

    Without ``smoothing`` the weights are those of largest marginal likelihood, for each dimension. They are not on the scale
    of any other package's penalty. ``count`` basis functions, 30 or K by default; more than K are an error, as K locations don't tell them apart.
    """
    w, t = _weights(k, pi), np.linspace(0, 1, k) if locations is None else np.asarray(locations, float)
    if count is not None and count > max(degree + 1, k):
        raise ValueError(f"{count} basis functions are more than the {k} locations")
    count = count or min(30, max(degree + 1, k))
    b = spline_basis(t, count, degree)
    differences = [np.diff(np.eye(count), n=o, axis=0) for o in ((order,) if isinstance(order, int) else order)]
    penalties = [d.T @ d for d in differences]
    fixed = None if smoothing is None else np.atleast_1d(np.asarray(smoothing, float))
    if fixed is not None and len(fixed) != len(penalties):
        raise ValueError("smoothing must have one weight for each order")

    def smooth(m: Moments):
        fits = [most_likely(m, j, b, penalties) if fixed is None else penalised_fit(m, j, b, penalties, fixed) for j in range(m.first.shape[1])]
        mu = b @ np.array([f.coef for f in fits]).T
        return w, mu, residual_variance(m, mu)

    return smooth


def wiener_covariance(t: np.ndarray, order: int) -> np.ndarray:
    """Covariance of the ``order``-fold integrated Wiener process, zero at t = 0 with its derivatives, by Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(order + 2)
    low = np.minimum(t[:, None], t[None, :])
    u = 0.5 * low[..., None] * (nodes + 1)
    f = ((t[:, None, None] - u) * (t[None, :, None] - u)) ** (order - 1) / math.factorial(order - 1) ** 2
    return (f * weights).sum(axis=2) * 0.5 * low


def transition(h: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """How a process and its first derivatives go on over a step: the Taylor matrix, and the covariance of what the step adds."""
    i = np.arange(order)
    fact = np.array([math.factorial(n) for n in range(2 * order)], float)
    power = i[None, :] - i[:, None]
    taylor = np.where(power >= 0, h ** np.maximum(power, 0) / fact[np.maximum(power, 0)], 0.0)
    left = order - 1 - i
    total = left[:, None] + left[None, :] + 1
    return taylor, h**total / (total * fact[left][:, None] * fact[left][None, :])


def filtered(t: np.ndarray, n: np.ndarray, y: np.ndarray, ratios: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filter and smoother for all ratios and dimensions at once, in one pass up and one down the K locations.

    ``y`` (K, d) are means of n observations (none where n is 0) of unit noise. Gives the posterior means (ratios, K, d), the squared innovations over their
    variances (ratios, d), and the log-determinants (ratios).
    """
    k, d = y.shape
    r = len(ratios)
    mean, cov = np.zeros((r, order, d)), np.repeat((WIDE * np.diag([math.factorial(i) ** 2.0 for i in range(order)]))[None], r, axis=0)
    fit, log_det = np.zeros((r, d)), np.zeros(r)
    before, after, steps = [], [], []
    eye = np.eye(order)
    for q in range(k):
        if q:
            f, add = transition(t[q] - t[q - 1], order)
            steps.append(f)
            mean, cov = f @ mean, f @ cov @ f.T + ratios[:, None, None] * add
        before.append((mean, cov))
        if n[q] > 0:
            noise = 1 / n[q]
            s = cov[:, 0, 0] + noise
            v = y[q] - mean[:, 0]
            gain = cov[:, :, 0] / s[:, None]
            keep = eye - gain[:, :, None] * eye[0]
            mean = mean + gain[:, :, None] * v[:, None, :]
            cov = keep @ cov @ np.swapaxes(keep, 1, 2) + noise * gain[:, :, None] * gain[:, None, :]
            fit += v * v / s[:, None]
            log_det += np.log(s)
        after.append((mean, cov))
    out = np.zeros((r, k, d))
    out[:, -1] = after[-1][0][:, 0]
    late = after[-1][0]
    for q in range(k - 2, -1, -1):
        (m, c), (m_next, c_next) = after[q], before[q + 1]
        back = np.swapaxes(np.linalg.solve(c_next, steps[q] @ c), 1, 2)
        late = m + back @ (late - m_next)
        out[:, q] = late[:, 0]
    return out, fit, log_det


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """Between the two values around half of the weight, each of which stands in the middle of its own."""
    by = np.argsort(values)
    return float(np.interp(0.5, np.cumsum(weights[by]) - weights[by] / 2, values[by]))


#: Prior variance of the polynomial's coefficients, relative to the noise.
WIDE = 1e6


def wiener_process(k: int, pi=None, order: int = 2, locations=None, prior_sd: float | None = None, scales=None, tol: float = 1e-6):
    """Posterior mean under an integrated Wiener process of the given order, on top of a polynomial with a wide prior.

    The process's scale relative to the noise is averaged by its posterior, with an exponential prior on the scale (median ``prior_sd``, if
    given): over the given ``scales``, or by a trapezoidal rule in the log of the scale around the largest posterior, whose step is halved until the
    means change by less than ``tol`` of their range, and the noise by less than a thousand times that. The noise variance is the posterior median. The work grows with K, not with its square or cube.
    """
    w, t = _weights(k, pi), np.linspace(0, 1, k) if locations is None else np.asarray(locations, float)
    by, t = np.argsort(t, kind="stable"), np.sort(t, kind="stable")
    t = t - t[0]

    def posterior(m: Moments, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log posterior (ratios, d), means (ratios, K, d) and noises (ratios, d)."""
        n, total = m.n[by], m.n.sum()
        y = m.first[by] / np.maximum(n, 1)[:, None]
        inner = (m.second[by] - n[:, None] * y * y)[n > 0].sum(axis=0)
        means, fit, log_det = filtered(t, n, y, ratios, order)
        rss = np.maximum(1e-300, inner + fit)
        noise = rss / max(1, total - order)
        logs = -0.5 * (total - order) * np.log(rss) - 0.5 * log_det[:, None]
        if prior_sd:  # an exponential density of the scale, on a grid that is even in the log of its square
            scale = np.sqrt(ratios[:, None] * noise)
            logs += np.log(scale) - math.log(2) * scale / prior_sd
        return logs, means, noise

    def averaged(logs: np.ndarray, means: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.exp(logs - logs.max(axis=0))
        p /= p.sum(axis=0)
        return np.einsum("rd,rkd->kd", p, means), np.array([weighted_median(n, q) for n, q in zip(noise.T, p.T)])

    def smooth(m: Moments):
        if scales is not None:
            mean, variance = averaged(*posterior(m, np.asarray(scales, float)))
        else:
            step, grid = 1.0, np.arange(-6.0, 12.5, 1.0)
            logs, means, noise = posterior(m, 10.0**grid)
            near = (logs > logs.max(axis=0) - 40).any(axis=1).nonzero()[0]  # where any dimension has weight
            low, high = grid[max(0, near[0] - 1)], grid[min(len(grid) - 1, near[-1] + 1)]
            mean, variance = averaged(logs, means, noise)
            for _ in range(8):
                step /= 2
                last, last_variance = mean, variance
                mean, variance = averaged(*posterior(m, 10.0 ** np.arange(low, high + step / 2, step)))
                if np.abs(mean - last).max() <= tol * max(1e-300, np.ptp(mean)) and np.abs(variance / last_variance - 1).max() <= 1e3 * tol:
                    break
        back = np.empty_like(mean)
        back[by] = mean
        return w, back, variance

    return smooth
