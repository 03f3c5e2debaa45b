"""Queries without SQL against plain numpy over all rows."""

import math

import numpy as np
import pytest

from strandline.operators import smoothers, tours
from strandline.plans.catalogue import QUERIES
from strandline.sources.matrices import energy_features

from .oracle import SF
from .test_models import density, plain_em


@pytest.fixture(scope="module")
def data(spark):
    got = energy_features(spark, SF).orderBy("id").collect()
    return [r["id"] for r in got], np.array([r["x"] for r in got])


class Start:
    def __init__(self, x, k):
        self.pi, self.mu, self.sigma = np.full(k, 1 / k), x[:k], np.repeat(np.diag(x.var(axis=0))[None], k, axis=0)


def test_best_model(spark, data):
    _, x = data
    n, d, k = len(x), 8, 5
    free = {"VVV": k * 36, "EEE": 36, "EEI": d, "EVI": 1 + k * (d - 1), "VEI": k + d - 1, "VVI": k * d, "EII": 1, "VII": k}
    free |= {"VEE": 35 + k, "EVE": 29 + 7 * k, "VVE": 28 + 8 * k, "EEV": 8 + 28 * k, "VEV": 7 + 29 * k, "EVV": 1 + 35 * k}
    got = {r["model"]: r["bic"] for r in QUERIES["em_best_model"](spark, SF).collect()}
    for model, count in free.items():
        params, trace = Start(x, k), []
        for _ in range(5):
            step = Start(x, k)
            step.pi, step.mu, step.sigma = plain_em(x, params, None, model, 1)
            params = step
            trace.append(np.log(density(x, params.pi, params.mu, params.sigma).sum(axis=1)).sum())
            if len(trace) > 1 and trace[-1] - trace[-2] < 1e-4:
                break
        assert got[model] == pytest.approx(2 * trace[-1] - (count + k * d + k - 1) * math.log(n), rel=1e-5)
    assert set(got) == set(free)


def hard(x, pi, mu, variance):
    return np.array([np.log(w) - 0.5 * (((x - m) ** 2) / variance + np.log(2 * np.pi * variance)).sum(axis=1) for w, m in zip(pi, mu)]).T


def threshold_em(x, k, smooth, draws=None, tol=1e-4, rounds=5):
    """Row-level threshold EM: ``smooth`` sees every row's location and values of one dimension."""
    pi, mu, variance, trace = np.full(k, 1 / k), x[:k], x.var(axis=0), []
    for step in range(1, rounds + 1):
        lj = hard(x, pi, mu, variance)
        ll = np.log(np.exp(lj).sum(axis=1) + 1e-300).sum()
        trace.append(ll)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol:
            break
        if draws is None:
            z = lj.argmax(axis=1)
        else:
            g = np.exp(lj - lj.max(axis=1, keepdims=True))
            z = np.minimum((np.cumsum(g / g.sum(axis=1, keepdims=True), axis=1) < draws(step)[:, None]).sum(axis=1), k - 1)
        fits = [smooth(z, x[:, j]) for j in range(x.shape[1])]
        mu, variance = np.array([f[0] for f in fits]).T, np.array([max(f[1], 1e-12) for f in fits])
    return mu, variance


def cubic(k, count):
    """Cardinal cubic splines in closed form."""
    u = np.linspace(0, 1, k)[:, None] * (count - 3) - np.arange(count) + 3
    pieces = [u**3, -3 * (u - 1) ** 3 + 3 * (u - 1) ** 2 + 3 * (u - 1) + 1, 3 * (u - 2) ** 3 - 6 * (u - 2) ** 2 + 4, (4 - u) ** 3]
    return sum(np.where((u >= i) & (u < i + 1), p, 0) for i, p in enumerate(pieces)) / 6


def spline(k, count, fixed=None):
    """With the given weight, or that of largest likelihood by golden sections around the best of many."""
    b, diff = cubic(k, count), np.diff(np.eye(count), n=2, axis=0)
    penalty = diff.T @ diff

    def smooth(z, y):
        rows = b[z]
        gram, right = rows.T @ rows, rows.T @ y

        def fit(log10):
            system = gram + 10.0**log10 * penalty + 1e-10 * np.trace(gram) / count * np.eye(count)
            coef = np.linalg.solve(system, right)
            return -0.5 * (len(y) - 2) * np.log(y @ y - right @ coef) - 0.5 * np.linalg.slogdet(system)[1] + 0.5 * (count - 2) * log10 * np.log(10), coef

        if fixed is None:
            mid = max(np.arange(-7, 11.5, 0.5), key=lambda e: fit(e)[0])
            low, high, gold = mid - 1, mid + 1, (math.sqrt(5) - 1) / 2
            while high - low > 1e-7:
                a, c = high - gold * (high - low), low + gold * (high - low)
                low, high = (low, c) if fit(a)[0] > fit(c)[0] else (a, high)
            at = (low + high) / 2
        else:
            at = math.log10(fixed)
        coef = fit(at)[1]
        return b @ coef, np.var(y - rows @ coef, ddof=1)

    return smooth


def test_splines(spark, data):
    _, x = data
    got = {(r["k"], r["j"]): (r["mean"], r["variance"]) for r in QUERIES["spline_threshold_em"](spark, SF).collect()}
    mu, variance = threshold_em(x, 10, spline(10, 8, 1.0))
    assert all(got[k + 1, j + 1] == (pytest.approx(mu[k, j], abs=2e-4), pytest.approx(variance[j], abs=2e-4)) for k in range(10) for j in range(8))
    curves = {(round(r["location"] * 9), r["dimension"]): r["mean"] for r in QUERIES["spline_threshold_em_ml"](spark, SF).collect()}
    mu, _ = threshold_em(x, 10, spline(10, 8))
    assert all(curves[k, j + 1] == pytest.approx(mu[k, j], abs=1e-3) for k in range(10) for j in range(8))


def test_wiener_process(spark, data):
    """The Gaussian process over rows, not over sums by location."""
    from strandline.operators.mixture import drawn

    ids, x = data
    t = np.linspace(0, 1, 10)
    base, wide = smoothers.wiener_covariance(t, 2), np.stack([np.ones(10), t], axis=1)
    ratios = 10.0 ** np.arange(-6, 12.01, 0.05)

    def smooth(z, y):
        logs, means, noises = [], [], []
        have, hits = np.unique(z, return_counts=True)
        raw = np.array([y[z == g].mean() for g in have])
        sums = raw
        for ratio in ratios:
            cov = ratio * base + 1e6 * wide @ wide.T
            # (M C M' + I)^-1 of row memberships M, by the K x K identity.
            small = np.linalg.inv(np.diag(1 / hits) + cov[np.ix_(have, have)])
            solved_means = small @ sums
            rss = y @ y - (raw**2 * hits).sum() + raw @ solved_means
            noise = rss / (len(y) - 2)
            scale = math.sqrt(ratio * noise)
            logs.append(-0.5 * (len(y) - 2) * math.log(rss) + 0.5 * np.linalg.slogdet(small)[1] + math.log(scale) - math.log(2) * scale / 0.5)
            means.append(cov[:, have] @ solved_means)
            noises.append(noise)
        p = np.exp(np.array(logs) - max(logs))
        p /= p.sum()
        by = np.argsort(noises)
        return p @ np.array(means), np.interp(0.5, np.cumsum(p[by]) - p[by] / 2, np.array(noises)[by])

    got = {(round(r["location"] * 9), r["dimension"]): r["mean"] for r in QUERIES["wiener_threshold_em"](spark, SF).collect()}
    mu, _ = threshold_em(x, 10, smooth, lambda step: np.array([drawn(1, step, i) for i in ids]))
    assert all(got[k, j + 1] == pytest.approx(mu[k, j], abs=2e-3) for k in range(10) for j in range(8))


def test_two_opt_has_no_better_reversal(spark, data):
    ids, x = data
    at = {v: i for i, v in enumerate(ids)}
    path = [at[r["id"]] for r in QUERIES["tour_two_opt"](spark, SF).orderBy("position").collect()]
    d = tours.distances(x)
    assert path[0] == tours.ends(d)[0] and sorted(path) == list(range(len(x)))
    assert tours.path_length(x, path) <= tours.path_length(x, tours.nearest_neighbour(d, *tours.ends(d)))
    p = np.array(path)
    for i in range(1, len(p) - 1):
        j = np.arange(i + 1, len(p))
        after = np.append(p[1:], p[-1])[j]
        gain = d[p[i - 1], p[i]] + np.where(j < len(p) - 1, d[p[j], after], 0) - d[p[i - 1], p[j]] - np.where(j < len(p) - 1, d[p[i], after], 0)
        assert gain.max() <= 1e-9


@pytest.mark.parametrize("linkage", ["single", "ward"])
def test_dendrograms(spark, data, linkage):
    """Agglomeration from what the linkages mean: least distance between members, or distance of centroids weighted by sizes."""
    ids, x = data
    d = tours.distances(x)
    parts = {i: [i] for i in range(len(x))}
    low = np.where(np.eye(len(x), dtype=bool), np.inf, d)
    centre, size = x.copy(), np.ones(len(x))
    while len(parts) > 1:
        i, j = sorted(np.unravel_index(np.argmin(low), low.shape))
        parts[i] = sum(sorted((parts[i], parts.pop(j)), key=min), [])
        if linkage == "single":
            low[i] = np.minimum(low[i], low[j])
        else:
            centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
            size[i] += size[j]
            low[i] = np.sqrt(2 * size[i] * size / (size[i] + size)) * np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        dead = [k for k in range(len(x)) if k not in parts]
        low[i, dead], low[i, i] = np.inf, np.inf
        low[:, i] = low[i]
        low[j], low[:, j] = np.inf, np.inf
    want = [ids[i] for i in parts[0]]
    assert [r["id"] for r in QUERIES[f"hierarchical_{linkage}"](spark, SF).orderBy("position").collect()] == want


@pytest.mark.parametrize("name", ["tsne_order", "umap_order"])
def test_layouts_keep_neighbours_near(spark, data, name):
    """Each row's nearest row stands nearer in the order than rows do by chance."""
    ids, x = data
    place = {r["id"]: r["position"] for r in QUERIES[name](spark, SF).collect()}
    d = tours.distances(x)
    np.fill_diagonal(d, np.inf)
    p = np.array([place[i] for i in ids])
    assert np.median(np.abs(p - p[d.argmin(axis=1)])) < 0.5 * np.median(np.abs(p[:, None] - p))
