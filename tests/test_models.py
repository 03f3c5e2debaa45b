"""Mixtures, priors, tours and orderings against independent numpy code, and their invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import linear, loss, mixture, ordering, plotdata, priors, sampling, selection, simulate, smoothers, threshold, tours
from strandline.operators.threshold import Moments
from strandline.sources.matrices import from_wide, to_wide, validated


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(parts)


@pytest.fixture(scope="module")
def curve():
    rng = np.random.default_rng(5)
    t = rng.uniform(0, 1, 300)
    return np.column_stack([t * 4 - 2, np.sin(3 * t)]) + 0.1 * rng.standard_normal((300, 2))


def density(x, pi, mu, sigma):
    out = []
    for w, m, s in zip(pi, mu, sigma):
        c = x - m
        out.append(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c)) / np.sqrt(np.linalg.det(2 * np.pi * s)))
    return np.array(out).T


def common_axes(scatter, n, total, model):
    """Axes that all components share, by turning two of them at a time to the best of many angles: another way than the library's."""
    k, d, _ = scatter.shape

    def loss(v):  # variances along the axes, times weights: (..., K, d)
        return (n * np.log(v / n[:, None]).sum(axis=-1)).sum(axis=-1) if model == "VVE" else np.prod(v ** (1 / d), axis=-1).sum(axis=-1)

    axes = np.linalg.eigh(scatter.sum(axis=0))[1]
    for _ in range(200):
        before = axes.copy()
        for i in range(d):
            for j in range(i):
                mid, reach = 0.0, np.pi / 4
                for _ in range(12):  # ever finer angles around the best
                    t = mid + np.linspace(-reach, reach, 21)
                    a, b = np.outer(np.cos(t), axes[:, i]) + np.outer(np.sin(t), axes[:, j]), np.outer(np.cos(t), axes[:, j]) - np.outer(np.sin(t), axes[:, i])
                    v = np.repeat(np.einsum("ji,kjl,li->ki", axes, scatter, axes)[None], len(t), axis=0)
                    v[..., i], v[..., j] = np.einsum("tj,kjl,tl->tk", a, scatter, a), np.einsum("tj,kjl,tl->tk", b, scatter, b)
                    best = int(np.argmin(loss(v)))
                    mid, reach = t[best], reach / 5
                axes[:, i], axes[:, j] = np.cos(mid) * axes[:, i] + np.sin(mid) * axes[:, j], np.cos(mid) * axes[:, j] - np.sin(mid) * axes[:, i]
        if np.abs(axes - before).max() < 1e-9:
            break
    v = np.einsum("ji,kjl,li->ki", axes, scatter, axes)
    size = np.prod(v ** (1 / d), axis=1, keepdims=True)
    v = v / n[:, None] if model == "VVE" else v / size * size.sum() / total
    return np.array([axes @ np.diag(u) @ axes.T for u in v])


def plain_em(x, p, prior, model, rounds):
    """Textbook EM with dense matrices."""
    pi, mu, sigma = p.pi, p.mu, p.sigma
    k, d = mu.shape
    for _ in range(rounds):
        g = density(x, pi, mu, sigma)
        g /= g.sum(axis=1, keepdims=True)
        n = np.maximum(g.sum(axis=0), 1e-8)
        plain = (g.T @ x) / n[:, None]
        scatter = np.array([((x - plain[j]) * g[:, [j]]).T @ (x - plain[j]) for j in range(k)])
        new = plain
        if prior is not None:
            h, rhs = np.zeros((k * d, k * d)), np.zeros(k * d)
            for j in range(k):
                inv = np.linalg.inv(sigma[j])
                h[j * d : (j + 1) * d, j * d : (j + 1) * d] = n[j] * inv
                rhs[j * d : (j + 1) * d] = inv @ (g[:, j] @ x)
            new = np.linalg.solve(h + prior, rhs).reshape(k, d)
        if model == "VVV":
            sigma = scatter / n[:, None, None] + 1e-6 * np.eye(d)
        elif model == "EEI":
            sigma = np.repeat(np.diag(np.diag(scatter.sum(axis=0)) / len(x) + 1e-6)[None], k, axis=0)
        elif model == "VII":
            sigma = np.array([np.trace(s) / (m * d) * np.eye(d) for s, m in zip(scatter, n)])
        elif model == "EEE":
            sigma = np.repeat(scatter.sum(axis=0)[None] / len(x), k, axis=0)
        elif model == "VVI":
            sigma = np.array([np.diag(np.diag(s)) / m for s, m in zip(scatter, n)])
        elif model == "EVI":
            size = [np.prod(np.diag(s)) ** (1 / d) for s in scatter]
            sigma = np.array([np.diag(np.diag(s)) / v * sum(size) / len(x) for s, v in zip(scatter, size)])
        elif model in ("EVE", "VVE"):
            sigma = common_axes(scatter, n, len(x), model)
        elif model == "EVV":
            size = [np.linalg.det(s) ** (1 / d) for s in scatter]
            sigma = np.array([s / v * sum(size) / len(x) for s, v in zip(scatter, size)])
        elif model == "VEE":
            form = np.eye(d)
            for _ in range(500):
                volume = [np.trace(s @ np.linalg.inv(form)) / (m * d) for s, m in zip(scatter, n)]
                form = sum(s / v for s, v in zip(scatter, volume))
                form = form / np.linalg.det(form) ** (1 / d)
            sigma = np.array([form * np.trace(s @ np.linalg.inv(form)) / (m * d) for s, m in zip(scatter, n)])
        elif model in ("EEV", "VEV"):
            turned = [np.linalg.svd(s) for s in scatter]
            volume, shape = np.ones(k), sum(t[1] for t in turned) / len(x)
            for _ in range(500 if model == "VEV" else 0):
                volume = np.array([np.sum(t[1] / shape) / (m * d) for t, m in zip(turned, n)])
                shape = sum(t[1] / v for t, v in zip(turned, volume))
                shape = shape / np.prod(shape) ** (1 / d)
            if model == "VEV":
                volume = np.array([np.sum(t[1] / shape) / (m * d) for t, m in zip(turned, n)])
            sigma = np.array([t[0] @ np.diag(shape * v) @ t[0].T for t, v in zip(turned, volume)])
        elif model == "VEI":
            shape = np.ones(d)
            for _ in range(500):
                volume = [np.sum(np.diag(s) / shape) / (m * d) for s, m in zip(scatter, n)]
                shape = sum(np.diag(s) / v for s, v in zip(scatter, volume))
                shape = shape / np.prod(shape) ** (1 / d)
            volume = [np.sum(np.diag(s) / shape) / (m * d) for s, m in zip(scatter, n)]
            sigma = np.array([np.diag(shape) * v for v in volume])
        else:
            sigma = np.repeat((np.trace(scatter.sum(axis=0)) / (n.sum() * d) * np.eye(d))[None], k, axis=0)
        pi, mu = n / len(x), new
    return pi, mu, sigma


@pytest.mark.parametrize("model", mixture.MODELS)
@pytest.mark.parametrize("with_prior", [False, True])
def test_em_matches_plain_numpy(spark, curve, model, with_prior):
    start = mixture.isotropic(np.full(4, 0.25), curve[:4], curve.var(axis=0))
    prior = priors.random_walk(4, 2, 1, 5.0) if with_prior else None
    got = mixture.fit(frame(spark, curve), start, prior, model, max_iter=3, tol=-math.inf)
    pi, mu, sigma = plain_em(curve, start, prior, model, 3)
    np.testing.assert_allclose(got.params.pi, pi, atol=1e-9)
    np.testing.assert_allclose(got.params.mu, mu, atol=1e-8)
    np.testing.assert_allclose(got.params.sigma, sigma, atol=1e-8)
    value = np.log(density(curve, pi, mu, sigma).sum(axis=1) + 1e-300).sum()
    if with_prior:
        value += -0.5 * mu.ravel() @ prior @ mu.ravel() + 0.5 * np.linalg.slogdet(prior)[1]
    assert got.trace[-1] == pytest.approx(value)


def test_partitions_do_not_matter_and_gamma_lags(spark, curve):
    start = mixture.isotropic(np.full(3, 1 / 3), curve[:3], 1.0)
    a, b = (mixture.fit(frame(spark, curve, n), start, model="EEI", max_iter=2, tol=-math.inf) for n in (1, 7))
    np.testing.assert_allclose(a.params.mu, b.params.mu, atol=1e-10)
    g = np.array([r["gamma"] for r in a.gamma(frame(spark, curve)).orderBy("id").collect()])
    np.testing.assert_allclose(g.sum(axis=1), 1)
    before = plain_em(curve, start, None, "EEI", 1)
    d = density(curve, *before)
    np.testing.assert_allclose(g, d / d.sum(axis=1, keepdims=True), atol=1e-8)


def test_unweighted_variant(spark, curve):
    start = mixture.isotropic(np.full(3, 1 / 3), curve[:3], 0.5)
    q = priors.var1(3, 2)
    got = mixture.fit(frame(spark, curve), start, q, "VVV", max_iter=1, mean_update="unweighted").params
    g = density(curve, start.pi, start.mu, start.sigma)
    g /= g.sum(axis=1, keepdims=True)
    n = g.sum(axis=0)
    mu = np.linalg.solve(np.diag(np.repeat(n, 2)) + q, (g.T @ curve).ravel()).reshape(3, 2)
    np.testing.assert_allclose(got.mu, mu, atol=1e-9)
    s = np.array([((curve - mu[j]) * g[:, [j]]).T @ (curve - mu[j]) / n[j] + 1e-6 * np.eye(2) for j in range(3)])
    np.testing.assert_allclose(got.sigma, s, atol=1e-9)
    data = frame(spark, curve)
    late, early = (mixture.fit(data, start, None, "VVV", max_iter=9, tol=1e9, mean_update="unweighted", late_params=v) for v in (True, False))
    assert late.converged and len(late.trace) == 2 and not np.allclose(late.params.mu, early.params.mu)


def test_objective_rises_without_a_prior(spark, curve):
    start = mixture.default_start(frame(spark, curve), 4, seed=2)
    assert (start.mu >= curve.min(axis=0)).all() and (start.mu <= curve.max(axis=0)).all()
    trace = mixture.fit(frame(spark, curve), start, model="VVV", max_iter=8, tol=-math.inf).trace
    assert all(b > a - 1e-3 for a, b in zip(trace, trace[1:]))


def test_stronger_prior_gives_a_straighter_path(spark, curve):
    start = mixture.isotropic(np.full(6, 1 / 6), np.linspace([-2, 0], [2, 0], 6), 1.0)
    bends = [np.abs(np.diff(mixture.fit(frame(spark, curve), start, priors.random_walk(6, 2, 2, s), "EEI", max_iter=5).params.mu, n=2, axis=0)).sum() for s in (1.0, 1e3, 1e6)]
    assert bends[0] > bends[1] > bends[2]


def test_tight_components_far_apart(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([1e5 + 1e-4 * rng.standard_normal((400, 2)), -1e5 + 1e-4 * rng.standard_normal((400, 2))])
    start = mixture.isotropic([0.5, 0.5], [[1e5, 1e5], [-1e5, -1e5]], 1.0)
    want = [x[:400].var(axis=0), x[400:].var(axis=0)]
    for model in ("VVI", "EEI", "VVV"):
        got = mixture.fit(frame(spark, x), start, None, model, max_iter=2, tol=-math.inf).params
        for k in range(2):
            own = np.mean(want, axis=0) + 1e-6 if model == "EEI" else want[k] + (1e-6 if model == "VVV" else 0)
            np.testing.assert_allclose(np.diag(got.sigma[k]), own, rtol=1e-3)
    s = mixture.statistics(frame(spark, x), start, True)
    np.testing.assert_allclose(s.scatter(s.sums() / s.weight[:, None]) / s.weight[:, None], want, rtol=1e-3)


@pytest.mark.parametrize("k, d, order", [(7, 3, 1), (7, 3, 2), (8, 2, 3), (5, 1, 4)])
def test_banded_priors_match_dense_ones(k, d, order):
    rng = np.random.default_rng(k)
    diff = np.diff(np.eye(k), n=order, axis=0)
    want = 3.0 * np.kron(diff.T @ diff + 1e-3 * np.eye(k), np.eye(d))
    a = rng.standard_normal((d, d))
    for band, dense in ((priors.random_walk(k, d, order, 3.0, 1e-3, banded=True), want), (priors.var1(k, d, 0.3 * a, a @ a.T + np.eye(d), banded=True), priors.var1(k, d, 0.3 * a, a @ a.T + np.eye(d), banded=False))):
        np.testing.assert_allclose(band.dense(), dense, atol=1e-12)
        u = rng.standard_normal(k * d)
        np.testing.assert_allclose(band @ u, dense @ u, atol=1e-10)
        np.testing.assert_allclose(band.solve(dense @ u), u, atol=1e-6)
        assert band.log_det() == pytest.approx(np.linalg.slogdet(dense)[1])
        blocks = np.array([np.eye(d) * (j + 1) for j in range(k)])
        np.testing.assert_allclose(priors.solved(band, blocks, u.reshape(k, d)), priors.solved(dense, blocks, u.reshape(k, d)), atol=1e-9)


def test_large_priors_are_banded(spark, curve):
    assert isinstance(priors.random_walk(100, 2), np.ndarray) and isinstance(priors.random_walk(101, 2), priors.Banded)
    q = priors.random_walk(2500, 8, 2, 10.0)
    assert q.size == 20_000 and q.solve(q @ np.ones(20_000)) == pytest.approx(np.ones(20_000), rel=1e-2)
    start = mixture.isotropic(np.full(120, 1 / 120), np.linspace([-2, 0], [2, 0], 120), 1.0)
    fits = [mixture.fit(frame(spark, curve), start, priors.random_walk(120, 2, 1, 10.0, banded=b), "EEI", max_iter=2, tol=-math.inf) for b in (True, False)]
    np.testing.assert_allclose(fits[0].params.mu, fits[1].params.mu, atol=1e-8)
    assert fits[0].trace == pytest.approx(fits[1].trace)


def test_linear_run_ends_at_an_objective_that_is_not_finite(spark, curve):
    with pytest.warns(UserWarning, match="finite"):
        got = linear.fit_linear(frame(spark, curve), 3, float("inf"), max_iter=5)
    assert got.trace == []


def test_exponential_prior_weights_match_integration():
    """The posterior over scales with an even grid in the log of the ratio, against a fine sum over the scale itself."""
    t = np.linspace(0, 1, 6)
    rng = np.random.default_rng(1)
    y = np.sin(3 * t) + 0.2 * rng.standard_normal(6)
    m = Moments(np.full(6, 3.0), 3 * y[:, None], (3 * y * y + 0.1)[:, None])
    coarse = smoothers.wiener_process(6, order=1, prior_sd=0.3, scales=10.0 ** np.arange(-2, 4.01, 0.25))(m)[1]
    base = smoothers.wiener_covariance(t, 1)
    wide = np.ones((6, 1))
    logs, means = [], []
    scales = np.linspace(0.005, 3.0, 3000)  # of the process, under each ratio's own noise
    n, inner = m.n.sum(), 0.6
    for ratio in scales**2 / 0.05:  # even in the square root of the ratio
        v = ratio * base + 1e6 * wide @ wide.T + np.diag(1 / m.n)
        solved = np.linalg.solve(v, y)
        rss = inner + y @ solved
        noise = rss / (n - 1)
        # The scale is sqrt(ratio * noise): its density times its step, with the noise at the value of this ratio.
        logs.append(-0.5 * (n - 1) * math.log(rss) - 0.5 * np.linalg.slogdet(v)[1] - math.log(2) * math.sqrt(ratio * noise) / 0.3 + 0.5 * math.log(noise))
        means.append((ratio * base + 1e6 * wide @ wide.T) @ solved)
    p = np.exp(np.array(logs) - max(logs))
    np.testing.assert_allclose(coarse[:, 0], (p / p.sum()) @ np.array(means), atol=0.02)


def test_errors(spark, curve):
    data = frame(spark, curve)
    start = mixture.isotropic([1.0], curve[:1], 1.0)
    with pytest.raises(ValueError, match="no such covariance model"):
        mixture.fit(data, start, model="XXX")
    with pytest.raises(ValueError, match="collapsed"):
        mixture.fit(frame(spark, np.ones((5, 2))), mixture.isotropic([1.0], np.ones((1, 2)), 1.0), model="VII", max_iter=3)
    with pytest.raises(ValueError):
        priors.random_walk(3, 2, 3)
    for rows, what in (([(1, [1.0]), (1, [2.0])], "twice"), ([(1, [1.0]), (2, [1.0, 2.0])], "between"), ([(1, [float("nan")])], "NaN"), ([(1, [None])], "null"), ([(None, [1.0])], "id is null")):
        with pytest.raises(ValueError, match=what):
            validated(spark.createDataFrame(rows, "id bigint, x array<double>"))


def test_priors():
    q = priors.random_walk(20, 2, 1, 10.0)
    np.testing.assert_allclose(q, q.T)
    np.testing.assert_allclose(q @ np.ones(40), 10 * 1e-6 * np.ones(40), atol=1e-12)
    v = priors.var1(20, 2, 0.8 * np.eye(2), 0.1 * np.eye(2))
    assert np.linalg.eigvalsh(v).min() == pytest.approx(0.290, abs=1e-3)
    assert priors.log_det(v) == pytest.approx(38 * math.log(10))
    assert priors.var1(1, 2).shape == (2, 2)


def test_linear(spark, curve):
    got = linear.fit_linear(frame(spark, curve), 5, 0.001, seed=1, max_iter=30)
    mean, pc = ordering.principal_components(frame(spark, curve))
    slope = got.slope / np.linalg.norm(got.slope)
    assert abs(slope @ pc[:, 0]) > 0.95
    np.testing.assert_allclose(got.params.mu, mean + got.grid[:, None] * got.slope)
    one = linear.fit_linear(frame(spark, curve[:, :1]), 3, slope=[0.5], max_iter=2)
    assert one.params.mu.shape == (3, 1)
    x = curve[:, :1] - curve[:, :1].mean()
    g = density(x, np.full(3, 1 / 3), np.array([[-0.5], [0.0], [0.5]]), np.ones((3, 1, 1)))
    g /= g.sum(axis=1, keepdims=True)
    t = np.array([-1, 0, 1])
    first = linear.fit_linear(frame(spark, curve[:, :1]), 3, slope=[0.5], max_iter=1)
    assert first.slope[0] == pytest.approx((t * (g.T @ x)[:, 0]).sum() / (1 + (g.sum(axis=0) * t**2).sum()))


def test_simulation(spark):
    rows, p = simulate.simulate_mixture(spark, 20_000, 4, 2, seed=3, projection=np.array([[1, -0.6], [-0.6, 1]]))
    got = rows.groupBy("z").agg(F.count("*").alias("n"), F.avg(F.col("x")[0]).alias("a"), F.var_pop(F.col("x")[1]).alias("v")).orderBy("z").collect()
    for r, m in zip(got, p.mu):
        assert r["n"] == pytest.approx(5000, rel=0.1) and r["a"] == pytest.approx(m[0], abs=0.03) and r["v"] == pytest.approx(0.1, rel=0.1)
    assert rows.orderBy("id").limit(5).collect() == simulate.simulate_mixture(spark, 20_000, 4, 2, seed=3, projection=np.array([[1, -0.6], [-0.6, 1]]))[0].orderBy("id").limit(5).collect()


def test_smoothers():
    rng = np.random.default_rng(1)
    t = np.linspace(0, 1, 12)
    n = rng.integers(1, 30, 12).astype(float)
    y = np.sin(4 * t) + 0.05 * rng.standard_normal(12)
    m = Moments(n, (n * y)[:, None], (n * (y**2 + 0.01))[:, None])
    _, mu, var = smoothers.group_means(12)(m)
    np.testing.assert_allclose(mu[:, 0], y)
    assert var[0] == pytest.approx(0.01 * n.sum() / (n.sum() - 1))
    line = np.polyval(np.polyfit(t, y, 1, w=np.sqrt(n)), t)
    _, mu, _ = smoothers.penalised_spline(12, count=8, smoothing=1e9)(m)
    np.testing.assert_allclose(mu[:, 0], line, atol=1e-3)
    _, mu, _ = smoothers.penalised_spline(12, count=8)(m)
    assert np.abs(mu[:, 0] - np.sin(4 * t)).max() < 0.15
    b = smoothers.spline_basis(t, 8)
    np.testing.assert_allclose(b.sum(axis=1), 1)
    _, mu, var = smoothers.wiener_process(12, prior_sd=0.5)(m)
    assert np.abs(mu[:, 0] - np.sin(4 * t)).max() < 0.15 and 0.005 < var[0] < 0.05
    c = smoothers.wiener_covariance(np.array([0.5, 1.0]), 2)
    np.testing.assert_allclose(c, [[0.5**3 / 3, 0.5**2 / 2 - 0.5**3 / 6], [0.5**2 / 2 - 0.5**3 / 6, 1 / 3]])
    with pytest.raises(ValueError):
        smoothers.group_means(3, [0.5, 0.5])


def test_threshold_em(spark, curve):
    start = mixture.isotropic(np.full(6, 1 / 6), np.linspace([-2, 0], [2, 0], 6), 1.0)
    data = frame(spark, curve)
    hard = threshold.fit_threshold(data, start, smoothers.penalised_spline(6, count=5, smoothing=0.1), max_iter=8)
    assert np.linalg.norm(np.diff(hard.params.mu, axis=0), axis=1).max() < 2
    a, b = (threshold.assign(frame(spark, curve, n), start, seed=3).orderBy("id").collect() for n in (1, 5))
    assert a == b
    g = np.array([r["gamma"] for r in mixture.e_step(data, start).orderBy("id").collect()])
    counts = np.bincount([r["k"] - 1 for r in a], minlength=6)
    assert np.abs(counts - g.sum(axis=0)).max() < 45
    threshold.fit_threshold(data, start, smoothers.wiener_process(6), threshold="stochastic", max_iter=2)


def brute_nn(x):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    best = max(((d[i, j], -j, -i) for i in range(len(x)) for j in range(i)), default=None)
    path = [-best[2]]
    while len(path) < len(x):
        path.append(min((j for j in range(len(x)) if j not in path), key=lambda j: (d[path[-1], j], j)))
    return path


def test_tours(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, size=(25, 2)).astype(float)
    path = [r["id"] for r in tours.tour(frame(spark, x)).orderBy("position").collect()]
    assert path == brute_nn(x)
    y = rng.uniform(size=(8, 2))
    d = tours.distances(y)
    start, end = tours.ends(d)
    best = min(sum(d[a, b] for a, b in zip(p, p[1:])) for p in itertools.permutations(range(8)) if p[0] == start)
    for method in tours.METHODS:
        p = tours.open_path(y, method)
        assert sorted(p) == list(range(8)) and p[0] == start and tours.path_length(y, p) >= best - 1e-9
    assert tours.path_length(y, tours.open_path(y, "two_opt")) <= tours.path_length(y, tours.open_path(y, "nn")) + 1e-9
    assert tours.open_path(y[:1]) == [0] and tours.open_path(y[:0]) == []
    with pytest.raises(ValueError, match="no such method"):
        tours.tour(frame(spark, y), "best")
    with pytest.raises(ValueError, match="at most"):
        tours.open_path(np.zeros((tours.MOST + 1, 1)))
    for block in (4, 100):
        r = tours.farthest_pair(frame(spark, x), block).first()
        d = tours.distances(x)
        assert (r["start"], r["end"]) == tours.ends(d) and r["distance"] == pytest.approx(d.max())


def test_farthest_pair_of_many_rows(spark):
    rng = np.random.default_rng(4)
    for x in (rng.standard_normal((900, 3)), np.round(rng.uniform(-1, 1, (900, 1)), 1), np.ones((300, 2)), rng.standard_normal((400, 2)) + 1e6):
        d = np.round(tours.distances(x), 9)
        got = tours.farthest_pair(frame(spark, x), block=100).first()
        start, end = tours.ends(d)
        assert got["distance"] == pytest.approx(d.max(), abs=1e-8) and d[got["start"], got["end"]] == pytest.approx(d.max(), abs=1e-8)
        if len(x) != 400:
            assert (got["start"], got["end"]) == (start, end)
    assert tours.far_rows(frame(spark, rng.standard_normal((2000, 3)))).count() < 400


@pytest.mark.parametrize("method", tours.METHODS)
def test_tours_of_equal_rows(method):
    for n in (2, 3, 6):
        path = tours.open_path(np.ones((n, 2)), method)
        assert sorted(path) == list(range(n)) and path[0] == 1


def test_pairs_in_blocks(spark):
    x = np.random.default_rng(6).standard_normal((150, 3))
    got = {(r["i"], r["j"]): r["distance"] for r in tours.pairwise(frame(spark, x), block=40).collect()}
    d = tours.distances(x)
    assert len(got) == 150 * 149 // 2 and all(i > j and v == pytest.approx(d[i, j]) for (i, j), v in got.items())
    assert "Cartesian" not in tours.pairwise(frame(spark, x))._jdf.queryExecution().toString()


def test_losses(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.uniform(0.1, 1, size=(40, 3))
    data, order = frame(spark, x), spark.createDataFrame([(int(i), p + 1) for p, i in enumerate(rng.permutation(40))], "id bigint, position int")
    path = [r["id"] for r in order.orderBy("position").collect()]
    for stretch in (100_000, 7):
        monkeypatch.setattr(loss, "STRETCH", stretch)
        assert loss.path_loss(data, order).first()[0] == pytest.approx(tours.path_length(x, path))
        assert loss.path_loss(data, order, normalise=True).first()[0] == pytest.approx(tours.path_length(x, path, True))
    back = order.withColumn("position", 41 - F.col("position"))
    assert loss.path_loss(data, back).first()[0] == pytest.approx(tours.path_length(x, path))
    assert loss.path_loss(frame(spark, x[:, :1]), order, normalise=True).first()[0] == 0
    with pytest.raises(ValueError):
        loss.path_loss(data, order.limit(3))
    with pytest.raises(Exception, match="sums to zero"):
        loss.path_loss(frame(spark, np.zeros((2, 2))), order.where("id < 2"), normalise=True).collect()
    assert loss.path_loss(frame(spark, x[:1]), order.where("id = 0")).first()[0] == 0


def test_selection(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(30, 4))
    got = selection.forward_selection(frame(spark, x), start=2).orderBy("step").collect()
    chosen, want = [], []
    while len(chosen) < 4:
        rest = [j for j in range(4) if j not in chosen] if chosen else [1]
        losses = [(tours.path_length(x[:, chosen + [j]], tours.open_path(x[:, chosen + [j]], "farthest_insertion")), j) for j in rest]
        chosen.append(min(losses)[1])
        want.append((chosen[-1] + 1, min(losses)[0]))
    assert [(r["factor"], pytest.approx(r["loss"])) for r in got] == want
    grouped = selection.grouped_forward_selection(frame(spark, x).withColumn("g", F.col("id") % 3), "g", weighted=True, fast=True, fast_rows=5)
    assert sorted(r["factor"] for r in grouped.collect()) == [1, 2, 3, 4]


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "a").when(F.col("id") < 999, "b").otherwise("c"))
    got = {r["g"]: r["n"] for r in sampling.sample_strata(df, "g", 50).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 50, "b": 50, "c": 1}
    assert sampling.sample_strata(df, "g", 50).where("g = 'c'").first()["id"] == 999
    a, b = (sorted(r["id"] for r in sampling.sample_rows(df.repartition(n), 20, seed=5).collect()) for n in (1, 8))
    assert a == b and len(a) == 20


@pytest.mark.parametrize("rows, n", [(5000, 40), (5000, 4990), (30, 40), (0, 3)])
def test_samples_have_the_smallest_hashes(spark, rows, n):
    import hashlib

    df = spark.range(rows, numPartitions=3).unionByName(spark.createDataFrame([(None,)], "id bigint"))
    got = [r["id"] for r in sampling.sample_rows(df, n, seed=4).collect()]
    want = [None] + sorted(range(rows), key=lambda i: hashlib.md5(f"4:{i}".encode()).hexdigest())
    assert got == want[:n]


def test_orderings_and_plot_tables(spark):
    x = np.random.default_rng(3).uniform(size=(50, 3))
    data = frame(spark, x, 5)
    assert [r["id"] for r in ordering.positions(data.select("id"), F.col("id")).orderBy("position").collect()] == list(range(50))
    scores = np.array([r["metric"] for r in ordering.pc_scores(data).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    v = np.linalg.svd(c)[2][0]
    np.testing.assert_allclose(scores, c @ (v * np.sign(v[np.abs(v).argmax()])), atol=1e-9)
    assert to_wide(from_wide(to_wide(data, 3), "id", ["f1", "f2", "f3"]), 3).orderBy("id").collect() == to_wide(data, 3).orderBy("id").collect()
    types = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(50)], "id bigint, type string")
    order = ordering.positions(data.select("id"), F.col("id"))
    got = plotdata.highlighted_types(types, ["a"], order=order)
    assert {r["Highlight"] for r in got.collect()} == {"a", "Other"} and got.first()["width"] == pytest.approx(1 / 50)
    dens = plotdata.type_density(types, ["a", "b"], order=order, points=200, span=(-1, 2)).groupBy("Type").agg(F.sum("density").alias("s")).collect()
    assert len(dens) == 2 and all(r["s"] * 3 / 199 == pytest.approx(1, abs=0.02) for r in dens)
    with pytest.raises(ValueError):
        plotdata.highlighted_types(types.where("id > 3"), ["a"], order=order)
    with pytest.raises(ValueError):
        plotdata.type_summary(types, ["a"])
    one = plotdata.structure_by_order(data, order, [2]).collect()
    assert len(one) == 50 and {r["Component"] for r in one} == {"loading2"}


def test_stream(spark, tmp_path, curve):
    from strandline.streaming.scoring import scored_stream, windowed_counts

    data = frame(spark, curve).withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    data.write.parquet(str(tmp_path / "in"))
    p = mixture.isotropic([0.5, 0.5], curve[:2], 1.0)
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = scored_stream(stream, p).select("id", "k").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    want = {r["id"]: int(np.argmax(r["gamma"])) + 1 for r in mixture.e_step(data, p).collect()}
    assert {r["id"]: r["k"] for r in spark.table("scored").collect()} == want
    q = windowed_counts(scored_stream(stream, p), "ts", "1 hour", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 300


def test_more_freedom_fits_no_worse():
    """At the same scatter a family that contains another one is at least as likely."""
    rng = np.random.default_rng(0)
    n, d = np.array([40.0, 60, 80, 100]), 5
    w = np.array([a.T @ a for a in (rng.standard_normal((int(m), d)) @ rng.standard_normal((d, d)) for m in n)])
    stats = mixture.Statistics(int(n.sum()), n, np.zeros((4, d)), w, np.zeros((4, d)), 0.0, 0.0, False)
    plain = mixture.Statistics(int(n.sum()), n, np.zeros((4, d)), np.einsum("kii->ki", w), np.zeros((4, d)), 0.0, 0.0, True)
    likely = {}
    for m in mixture.MODELS:
        s = mixture.covariances(stats if m in mixture.FULL else plain, np.zeros((4, d)), n, m)
        likely[m] = -0.5 * sum(c * np.linalg.slogdet(v)[1] + np.trace(x @ np.linalg.inv(v)) for c, v, x in zip(n, s, w))
    order = [("EII", "VII"), ("EII", "EEI"), ("EEI", "VEI"), ("EEI", "EVI"), ("EVI", "VVI"), ("VEI", "VVI"), ("EEI", "EEE"), ("EEE", "VEE"), ("EEE", "EVE"), ("VEE", "VVE"), ("EVE", "VVE"), ("EEE", "EEV"), ("EEV", "VEV"), ("EEV", "EVV"), ("VEV", "VVV"), ("EVV", "VVV"), ("VVI", "VVE")]
    assert all(likely[a] <= likely[b] + 1e-6 for a, b in order) and len(likely) == 14
    with pytest.raises(mixture.Collapsed):
        mixture.covariances(mixture.Statistics(9, n, np.zeros((4, d)), 0 * w, np.zeros((4, d)), 0.0, 0.0, False), np.zeros((4, d)), n, "EVV")


def test_wrong_options_are_no_collapse(spark, curve):
    with pytest.raises(ValueError, match="max_iter"):
        mixture.best_model(frame(spark, curve), mixture.isotropic([0.5, 0.5], curve[:2], 1.0), max_iter=0)
    with pytest.raises(ValueError, match="no rows"):
        mixture.default_start(frame(spark, curve).limit(0), 2)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.standard_normal(501), "b": np.round(rng.exponential(1, 300), 1), "c": 2.0 ** np.arange(-500, 500), "d": np.array([3.5]), "e": np.full(40, -1.0), "f": np.array([-1e308, 1e308, 0.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("g", None), (None, 2.0)]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = plotdata.quantiles(spark.createDataFrame(rows, "t string, x double").repartition(5), "t", "x", at, bins=8)
    assert set(got) - {None} == set(groups)
    for g, x in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(x / 4, at) * 4, rtol=1e-12)


def test_violins_and_points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(200), rng.exponential(2, 100), [5.0]])
    types = spark.createDataFrame([(i, "a" if i < 200 else "b" if i < 300 else "lone") for i in range(301)], "id bigint, type string")
    metric = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, metric double")
    got = plotdata.type_violin(types, ["a", "b", "lone"], metric=metric, points=101).orderBy("Type", "i").collect()
    assert {r["Type"] for r in got} == {"a", "b"} and max(r["width"] for r in got) == 1 and len(got) == 202
    for t, own in (("a", x[:200]), ("b", x[200:300])):
        rows = [r for r in got if r["Type"] == t]
        h = 0.9 * min(own.std(ddof=1), (np.quantile(own, 0.75) - np.quantile(own, 0.25)) / 1.34) * len(own) ** -0.2
        assert rows[0]["at"] == pytest.approx(own.min() - 3 * h) and rows[-1]["at"] == pytest.approx(own.max() + 3 * h)
        assert sum(r["density"] for r in rows) * (rows[1]["at"] - rows[0]["at"]) == pytest.approx(1, abs=0.01)
    aside = [plotdata.type_points(types.repartition(n), ["a", "b"], metric=metric, width=0.1).orderBy("Sample").collect() for n in (1, 7)]
    assert aside[0] == aside[1] and len(aside[0]) == 300
    offsets = np.array([r["offset"] for r in aside[0]])
    assert np.abs(offsets).max() <= 0.1 and np.std(offsets) == pytest.approx(0.2 / np.sqrt(12), rel=0.1)


def moments(k=12, seed=1, gaps=()):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, k)
    n = rng.integers(1, 30, k).astype(float)
    n[list(gaps)] = 0
    y = np.sin(4 * t)[:, None] * [1, 0.2] + 0.1 * rng.standard_normal((k, 2))
    return t, Moments(n, n[:, None] * y, n[:, None] * (y**2 + 0.01))


@pytest.mark.parametrize("order", [2, (2,), (1, 3), (3, 2)])
def test_weights_of_the_spline_are_most_likely(order):
    """At the weights the derivative is 0, as the difference of the likelihood says too; none of many others is more likely."""
    t, m = moments()
    b = smoothers.spline_basis(t, 9)
    penalties = [(lambda d: d.T @ d)(np.diff(np.eye(9), n=o, axis=0)) for o in np.atleast_1d(order)]
    for j in range(2):
        best = smoothers.most_likely(m, j, b, penalties)
        weights = np.clip(best.following, smoothers.LEAST_WEIGHT, smoothers.MOST_WEIGHT)
        inside = (weights > 10 * smoothers.LEAST_WEIGHT) & (weights < smoothers.MOST_WEIGHT / 10)
        assert np.abs(best.slope[inside]).max(initial=0) < 1e-4 and inside.any()
        for i in np.flatnonzero(inside):
            up, down = (smoothers.penalised_fit(m, j, b, penalties, weights * np.where(np.arange(len(weights)) == i, f, 1)).value for f in (1.01, 1 / 1.01))
            assert max(up, down) <= best.value + 1e-9
        if len(penalties) == 1:
            assert all(smoothers.penalised_fit(m, j, b, penalties, np.array([10.0**e])).value <= best.value + 1e-9 for e in np.arange(-7, 11, 0.25))
    assert smoothers.penalised_spline(12, count=9, order=order)(m)[1].shape == (12, 2)


def test_spline_options():
    with pytest.raises(ValueError, match="more than"):
        smoothers.penalised_spline(6, count=9)
    with pytest.raises(ValueError, match="one weight"):
        smoothers.penalised_spline(12, order=(1, 2), smoothing=3.0)
    assert smoothers.penalised_spline(3)(moments(3)[1])[1].shape == (3, 2)


def dense_wiener(t, m, ratio, order):
    """The same posterior by the process's covariance matrix."""
    have = m.n > 0
    cov = ratio * smoothers.wiener_covariance(t - t.min(), order) + 1e6 * sum(np.outer(t**p, t**p) for p in range(order))
    v = cov[np.ix_(have, have)] + np.diag(1 / m.n[have])
    y = m.first[have] / m.n[have][:, None]
    return cov[:, have] @ np.linalg.solve(v, y), (y * np.linalg.solve(v, y)).sum(axis=0), np.linalg.slogdet(v)[1]


@pytest.mark.parametrize("k, order", [(7, 1), (12, 2), (100, 2), (30, 3)])
def test_filter_agrees_with_the_dense_process(k, order):
    t, m = moments(k, gaps=(3, k - 2))
    ratios = np.array([0.1, 30.0, 1e4])
    mean, fit, log_det = smoothers.filtered(t, m.n, m.first / np.maximum(m.n, 1)[:, None], ratios, order)
    for r, ratio in enumerate(ratios):
        want = dense_wiener(t, m, ratio, order)
        for got, w in zip((mean[r], fit[r], log_det[r]), want):
            np.testing.assert_allclose(got, w, rtol=1e-6, atol=1e-6)


def test_quadrature_ends_where_a_finer_one_does():
    t, m = moments(20, gaps=(0, 7))
    for prior in (None, 0.3):
        _, mu, var = smoothers.wiener_process(20, prior_sd=prior)(m)
        _, fine, fine_var = smoothers.wiener_process(20, prior_sd=prior, scales=10.0 ** np.arange(-6, 12.001, 0.005))(m)
        np.testing.assert_allclose(mu, fine, atol=2e-5)
        np.testing.assert_allclose(var, fine_var, rtol=2e-3)
    turned = np.random.default_rng(0).permutation(20)
    shuffled = Moments(m.n[turned], m.first[turned], m.second[turned])
    np.testing.assert_allclose(smoothers.wiener_process(20, locations=t[turned])(shuffled)[1], smoothers.wiener_process(20)(m)[1][turned])
