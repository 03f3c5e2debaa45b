"""The library's queries over the driver's tables, and the SQL that gives the same rows.

Real numbers are rounded to four decimals on both sides, after sums are brought to moderate size. Queries without SQL
(random draws, eigenvectors, layouts) are held against brute force and invariants in the tests.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import cosine, from_python, logsumexp, manhattan
from ..functions.means import exact_mean
from ..operators import embed, linear, loss, mixture, ordering, plotdata, priors, sampling, selection, simulate, smoothers, threshold, tours
from ..operators.mixture import Params
from ..sources.matrices import energy_features, lineitem_features, read_table, validated

D = 8
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

F1 = """f1 AS MATERIALIZED (SELECT vec_id AS id, label::VARCHAR AS grp, list_transform(range(0, 8), lambda j:
 list_sum(list_transform(embedding[j * 8 + 1 : j * 8 + 8], lambda e: e::DOUBLE * e::DOUBLE))) AS x FROM embeddings)"""
F2 = "f2 AS MATERIALIZED (SELECT vec_id AS id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS x FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda j: (a.x[j] - b.x[j]) * (a.x[j] - b.x[j]))))"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r4(c, digits: int = 4):
    return F.round(c, digits)


def two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(v[0], v[1]).alias("x"))


def first_rows(data: DataFrame, k: int) -> Params:
    """Equal weights, the rows with id < k as means, the columns' variances as the shared covariance."""
    mu = np.array([r["x"] for r in data.where(F.col("id") < k).orderBy("id").select("x").collect()], float)
    return mixture.isotropic(np.full(len(mu), 1 / len(mu)), mu, mixture.column_summary(data)["variance"])


# SQL of expectation-maximisation with a shared diagonal covariance, one CTE a step -----------------------------------------


def sql_start(k: int, src: str = "f1", d: int = D) -> str:
    var = ", ".join(f"var_pop(x[{j}])" for j in range(1, d + 1))
    return f"""p0 AS MATERIALIZED (SELECT id + 1 AS k, 1.0 / {k} AS w, x AS mu FROM {src} WHERE id < {k}),
v0 AS MATERIALIZED (SELECT [{var}] AS v FROM {src})"""


def sql_e(t: int, src: str = "f1", d: int = D, params: str = "p{0}, v{0}") -> str:
    lp = f"ln(w) - 0.5 * (list_sum(list_transform(range(1, {d + 1}), lambda j: (x[j] - mu[j]) * (x[j] - mu[j]) / v[j] + ln(v[j]))) + {d} * ln(2 * pi()))"
    return f"""l{t} AS MATERIALIZED (SELECT id, x, k, {lp} AS lp FROM {src}, {params.format(t)}),
m{t} AS (SELECT *, max(lp) OVER (PARTITION BY id) AS m FROM l{t}),
g{t} AS MATERIALIZED (SELECT id, x, k, exp(lp - m) / sum(exp(lp - m)) OVER (PARTITION BY id) AS g, m + ln(sum(exp(lp - m)) OVER (PARTITION BY id)) AS ll FROM m{t})"""


def sql_m(t: int, src: str = "f1", d: int = D) -> str:
    mu = ", ".join(f"sum(g * x[{j}]) / sum(g)" for j in range(1, d + 1))
    v = ", ".join(f"sum(g * (x[{j}] - mu[{j}]) ** 2) / (SELECT count(*) FROM {src}) + 1e-6" for j in range(1, d + 1))
    return f"""p{t + 1} AS MATERIALIZED (SELECT k, sum(g) / (SELECT count(*) FROM {src}) AS w, [{mu}] AS mu FROM g{t} GROUP BY k),
v{t + 1} AS MATERIALIZED (SELECT [{v}] AS v FROM g{t} JOIN p{t + 1} USING (k))"""


def sql_solve(tag: str, src: str, n: int) -> str:
    """CTEs for Gauss-Jordan elimination of src(g, r, c, v), rows 1..n and columns 0 (the right side) to n: u<tag>(g, r, v) and the pivots' logs w<tag>(g, v)."""
    out, last = [], src
    for p in range(1, n + 1):
        out.append(f"""{tag}{p} AS MATERIALIZED (SELECT a.g, a.r, a.c, CASE WHEN a.r = {p} THEN a.v / i.v ELSE a.v - f.v * o.v / i.v END AS v, i.v AS pv FROM {last} a
 JOIN {last} i ON i.g = a.g AND i.r = {p} AND i.c = {p} JOIN {last} o ON o.g = a.g AND o.r = {p} AND o.c = a.c JOIN {last} f ON f.g = a.g AND f.r = a.r AND f.c = {p})""")
        last = f"{tag}{p}"
    logs = " UNION ALL ".join(f"SELECT DISTINCT g, ln(pv) AS v FROM {tag}{p}" for p in range(1, n + 1))
    return ",\n".join([*out, f"u{tag} AS (SELECT g, r, v FROM {last} WHERE c = 0)", f"w{tag} AS (SELECT g, sum(v) AS v FROM ({logs}) GROUP BY g)"])


#: Priors of one dimension, (r, c, v): both priors are the same in each dimension here.
def sql_walk_prior(k: int, order: int, strength: float) -> str:
    coef = {1: "CASE c - r WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END", 2: "CASE c - r WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1 ELSE 0 END"}[order]
    return f"""dw AS (SELECT r, c, {coef} AS v FROM range(1, {k - order + 1}) a(r), range(1, {k + 1}) b(c)),
prior AS MATERIALIZED (SELECT a.c AS r, b.c AS c, ({strength} * (sum(a.v * b.v) + CASE WHEN a.c = b.c THEN 1e-6 ELSE 0 END))::DOUBLE AS v FROM dw a JOIN dw b USING (r) GROUP BY a.c, b.c)"""


def sql_var_prior(k: int) -> str:
    return f"""prior AS MATERIALIZED (SELECT r, c, (CASE WHEN r = c THEN CASE WHEN r = 1 THEN 1.0 ELSE 10.0 END + CASE WHEN r < {k} THEN 6.4 ELSE 0 END WHEN abs(r - c) = 1 THEN -8.0 ELSE 0 END)::DOUBLE AS v
 FROM range(1, {k + 1}) a(r), range(1, {k + 1}) b(c))"""


def sql_prior_em(iterations: int, k: int, prior: str, unweighted: bool = False) -> str:
    """EM under a prior: EEI with the weighted update, or VII (v<t> by k) with the unweighted one."""
    out = [F1, sql_start(k), prior]
    if unweighted:
        out.append("vk0 AS (SELECT k, v FROM p0, v0)")
    for t in range(iterations):
        out.append(sql_e(t, params="p{0} JOIN vk{0} USING (k)" if unweighted else "p{0}, v{0}"))
        plain = ", ".join(f"sum(g * x[{j}]) / sum(g)" for j in range(1, D + 1))
        out.append(f"n{t} AS MATERIALIZED (SELECT k, sum(g) AS n, [{plain}] AS plain FROM g{t} GROUP BY k)")
        own, v = ("1.0", "") if unweighted else (f"v{t}.v[j]", f", v{t}")
        out.append(f"""a{t} AS MATERIALIZED (SELECT j AS g, r, c, q.v + CASE WHEN r = c THEN n / {own} ELSE 0 END AS v FROM prior q JOIN n{t} ON k = r, range(1, {D + 1}) d(j){v}
 UNION ALL SELECT j, k, 0, n * plain[j] / {own} FROM n{t}, range(1, {D + 1}) d(j){v})""")
        out.append(sql_solve(f"e{t}_", f"a{t}", k))
        out.append(f"p{t + 1} AS MATERIALIZED (SELECT k, any_value(n) / (SELECT count(*) FROM f1) AS w, list(v ORDER BY g) AS mu FROM ue{t}_ JOIN n{t} ON k = r GROUP BY k)")
        if unweighted:
            out.append(f"vk{t + 1} AS MATERIALIZED (SELECT k, list_transform(range(1, {D + 1}), lambda j: s) AS v FROM (SELECT k, sum(g * list_sum(list_transform(range(1, {D + 1}), lambda j: (x[j] - mu[j]) * (x[j] - mu[j])))) / (sum(g) * {D}) AS s FROM g{t} JOIN p{t + 1} USING (k) GROUP BY k))")
        else:
            v = ", ".join(f"sum(g * (x[{j}] - plain[{j}]) ** 2) / (SELECT count(*) FROM f1) + 1e-6" for j in range(1, D + 1))
            out.append(f"v{t + 1} AS MATERIALIZED (SELECT [{v}] AS v FROM g{t} JOIN n{t} USING (k))")
    return ",\n".join(out)


DRAW = "('0x' || substr(md5({0}), 1, 13))::BIGINT / 2.0 ** 52"


def sql_em(iterations: int, k: int) -> str:
    return ",\n".join([F1, sql_start(k)] + [x for t in range(iterations) for x in (sql_e(t), sql_m(t))])


def long_params(spark: SparkSession, p: Params, cov: bool = True) -> DataFrame:
    """k, j, weight, mean, and the diagonal of the covariance."""
    rows = [(k + 1, j + 1, float(p.pi[k]), float(p.mu[k, j]), float(p.sigma[k, j, j])) for k in range(p.shape[0]) for j in range(p.shape[1])]
    got = spark.createDataFrame(rows, "k int, j int, weight double, mean double, variance double")
    return got.select("k", "j", *[r4(F.col(c)).alias(c) for c in ("weight", "mean", "variance")])


LONG_PARAMS = "SELECT k::INT AS k, j::INT AS j, round(w, 4) AS weight, round(mu[j], 4) AS mean, round(v[j], 4) AS variance FROM p{0}, v{0}, range(1, 9) t(j)"


@query(f"WITH {F1},\n{sql_start(5)},\n{sql_e(0)} SELECT id, k::INT AS k, round(g, 4) AS gamma FROM g0")
def estep_eei(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    got = mixture.e_step(data, first_rows(data, 5))
    return got.select("id", F.posexplode("gamma").alias("j", "g")).select("id", (F.col("j") + 1).alias("k"), r4(F.col("g")).alias("gamma"))


@query(ORACLES["estep_eei"])
def estep_expressions(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    got = data.withColumn("gamma", mixture.e_step_expressions(F.col("x"), first_rows(data, 5)))
    return got.select("id", F.posexplode("gamma").alias("j", "g")).select("id", (F.col("j") + 1).alias("k"), r4(F.col("g")).alias("gamma"))


FULL = [[0.02, 0.005], [0.005, 0.03]]


@query(f"""WITH {F2}, p AS (SELECT id + 1 AS k, x AS mu, (id + 1)::DOUBLE AS s FROM f2 WHERE id < 3),
q AS (SELECT a.id, k, -0.5 * ((0.03 * (a.x[1] - mu[1]) ** 2 - 2 * 0.005 * (a.x[1] - mu[1]) * (a.x[2] - mu[2]) + 0.02 * (a.x[2] - mu[2]) ** 2)
 / ((0.02 * 0.03 - 0.005 * 0.005) * s) + ln((0.02 * 0.03 - 0.005 * 0.005)::DOUBLE * s * s)) AS lp FROM f2 a, p)
SELECT id, k::INT AS k, round(exp(lp) / sum(exp(lp)) OVER (PARTITION BY id), 4) AS gamma FROM q""")
def estep_vvv(spark, sf_dir):
    data = two_features(spark, sf_dir)
    mu = first_rows(data, 3).mu
    p = Params(np.full(3, 1 / 3), mu, np.array([np.array(FULL) * (k + 1) for k in range(3)]))
    got = mixture.e_step(data, p)
    return got.select("id", F.posexplode("gamma").alias("j", "g")).select("id", (F.col("j") + 1).alias("k"), r4(F.col("g")).alias("gamma"))


@query(f"WITH {F1} SELECT id, round(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))), 4) AS lse FROM f1")
def logsumexp_rows(spark, sf_dir):
    return energy_features(spark, sf_dir).select("id", r4(logsumexp(F.col("x"))).alias("lse"))


@query(f"WITH {F1} SELECT j::INT AS j, round(min(x[j]), 4) AS least, round(max(x[j]), 4) AS most FROM f1, range(1, 9) t(j) GROUP BY j")
def init_box(spark, sf_dir):
    s = mixture.column_summary(energy_features(spark, sf_dir))
    return spark.createDataFrame([(j + 1, float(a), float(b)) for j, (a, b) in enumerate(zip(s["least"], s["most"]))], "j int, least double, most double").select("j", r4(F.col("least")).alias("least"), r4(F.col("most")).alias("most"))


@query(f"""WITH {F1}, b AS (SELECT j, min(x[j]) AS a, max(x[j]) AS z FROM f1, range(1, 9) t(j) GROUP BY j)
SELECT k::INT AS k, j::INT AS j, 0.2::DOUBLE AS weight, round(a + {DRAW.format("'1:' || k || ':' || j")} * (z - a), 4) AS mean, 1.0::DOUBLE AS variance FROM b, range(1, 6) r(k)""")
def default_start(spark, sf_dir):
    return long_params(spark, mixture.default_start(energy_features(spark, sf_dir), 5, seed=1))


def one_step(spark, sf_dir, model: str, k: int = 5, **options) -> Params:
    data = energy_features(spark, sf_dir)
    start = first_rows(data, k).cached()
    return mixture.m_step(mixture.statistics(data, start, model not in mixture.FULL), start, None, model, **options)


@query(f"WITH {sql_em(1, 5)} SELECT k::INT AS k, j::INT AS j, round(w, 4) AS weight, round(mu[j], 4) AS mean FROM p1, range(1, 9) t(j)")
def mstep_weights_means(spark, sf_dir):
    return long_params(spark, one_step(spark, sf_dir, "EEI")).select("k", "j", "weight", "mean")


@query(f"WITH {sql_em(1, 5)} SELECT k::INT AS k, j::INT AS j, round(v[j], 6) AS variance FROM p1, v1, range(1, 9) t(j)")
def mstep_cov_eei(spark, sf_dir):
    return diagonal(spark, one_step(spark, sf_dir, "EEI"))


def diagonal(spark, p: Params) -> DataFrame:
    rows = [(k + 1, j + 1, float(p.sigma[k, j, j])) for k in range(p.shape[0]) for j in range(p.shape[1])]
    return spark.createDataFrame(rows, "k int, j int, variance double").select("k", "j", r4(F.col("variance"), 6).alias("variance"))


SQ = "list_sum(list_transform(range(1, 9), lambda j: (x[j] - mu[j]) * (x[j] - mu[j])))"


@query(f"""WITH {sql_em(1, 5)}, s AS (SELECT k, sum(g * {SQ}) / (sum(g) * 8) AS v FROM g0 JOIN p1 USING (k) GROUP BY k)
SELECT k::INT AS k, j::INT AS j, round(v, 6) AS variance FROM s, range(1, 9) t(j)""")
def mstep_cov_vii(spark, sf_dir):
    return diagonal(spark, one_step(spark, sf_dir, "VII"))


@query(f"""WITH {sql_em(1, 5)}, s AS (SELECT sum(g * {SQ}) / (sum(g) * 8) AS v FROM g0 JOIN p1 USING (k))
SELECT k::INT AS k, j::INT AS j, round(v, 6) AS variance FROM s, p1, range(1, 9) t(j)""")
def mstep_cov_eii(spark, sf_dir):
    return diagonal(spark, one_step(spark, sf_dir, "EII"))


@query(f"""WITH {sql_em(1, 5)} SELECT k::INT AS k, i::INT AS i, j::INT AS j,
 round(sum(g * (x[i] - mu[i]) * (x[j] - mu[j])) / sum(g) + CASE WHEN i = j THEN 1e-6 ELSE 0 END, 6) AS value
FROM g0 JOIN p1 USING (k), range(1, 9) a(i), range(1, 9) b(j) GROUP BY k, i, j""")
def mstep_cov_vvv(spark, sf_dir):
    p = one_step(spark, sf_dir, "VVV")
    rows = [(k + 1, i + 1, j + 1, float(p.sigma[k, i, j])) for k in range(5) for i in range(D) for j in range(D)]
    return spark.createDataFrame(rows, "k int, i int, j int, value double").withColumn("value", r4(F.col("value"), 6))


@query(f"""WITH {sql_em(1, 5)} SELECT k::INT AS k, j::INT AS j, round(sum(g * (x[j] - mu[j]) ** 2) / sum(g), 6) AS variance FROM g0 JOIN p1 USING (k), range(1, 9) t(j) GROUP BY k, j""")
def mstep_cov_vvi(spark, sf_dir):
    return diagonal(spark, one_step(spark, sf_dir, "VVI"))


@query(f"""WITH {sql_em(1, 5)}, s AS (SELECT k, j, sum(g * (x[j] - mu[j]) ** 2) AS s FROM g0 JOIN p1 USING (k), range(1, 9) t(j) GROUP BY k, j),
z AS (SELECT *, exp(avg(ln(s)) OVER (PARTITION BY k)) AS size FROM s)
SELECT k::INT AS k, j::INT AS j, round(s / size * (SELECT sum(size) / 8 FROM z) / (SELECT count(*) FROM f1), 6) AS variance FROM z""")
def mstep_cov_evi(spark, sf_dir):
    return diagonal(spark, one_step(spark, sf_dir, "EVI"))


@query(f"""WITH {sql_em(1, 5)} SELECT k::INT AS k, i::INT AS i, j::INT AS j, round((SELECT sum(g * (x[i] - mu[i]) * (x[j] - mu[j])) FROM g0 JOIN p1 USING (k)) / (SELECT count(*) FROM f1), 6) AS value
FROM range(1, 6) r(k), range(1, 9) a(i), range(1, 9) b(j)""")
def mstep_cov_eee(spark, sf_dir):
    p = one_step(spark, sf_dir, "EEE")
    rows = [(k + 1, i + 1, j + 1, float(p.sigma[k, i, j])) for k in range(5) for i in range(D) for j in range(D)]
    return spark.createDataFrame(rows, "k int, i int, j int, value double").withColumn("value", r4(F.col("value"), 6))


@query(f"WITH {sql_em(1, 5)} SELECT k::INT AS k, j::INT AS j, round(mu[j], 4) AS mean FROM p1, range(1, 9) t(j)")
def mstep_unweighted_flat(spark, sf_dir):
    """The unweighted update without a prior gives the plain means."""
    return long_params(spark, one_step(spark, sf_dir, "VII", mean_update="unweighted")).select("k", "j", "mean")


@query(f"WITH {sql_em(3, 5)} {LONG_PARAMS.format(3)}")
def em_eei_3iter(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return long_params(spark, mixture.fit(data, first_rows(data, 5), model="EEI", max_iter=3, tol=-math.inf).params)


@query("WITH " + sql_em(3, 5) + ", " + sql_e(3) + " " + " UNION ALL ".join(f"SELECT {t} AS iter, round(sum(ln(exp(ll) + 1e-300)) / count(*), 4) AS objective FROM (SELECT DISTINCT id, ll FROM g{t})" for t in (1, 2, 3)))
def em_objective_trace(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    got = mixture.fit(data, first_rows(data, 5), model="EEI", max_iter=3, tol=-math.inf).trace_frame(spark)
    return got.select("iter", r4(F.col("objective") / F.lit(data.count())).alias("objective"))


@query(f"""WITH {sql_em(3, 5)}, z AS (SELECT id, arg_min(k, {{'g': -g, 'k': k}}) AS k FROM g2 GROUP BY id)
SELECT id, k::INT AS k, row_number() OVER (ORDER BY k, id) AS position FROM z""")
def map_component_order(spark, sf_dir):
    """The order by the responsibilities that lag one update behind the returned parameters."""
    data = energy_features(spark, sf_dir)
    return mixture.fit(data, first_rows(data, 5), model="EEI", max_iter=3, tol=-math.inf).ordering(data)


def prior_fit(spark, sf_dir, q, **options):
    data = energy_features(spark, sf_dir)
    return data, mixture.fit(data, first_rows(data, 5), prior=q, model="EEI", max_iter=3, tol=-math.inf, **options)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order the embeddings' rows along a mixture path with a random-walk prior: id, k, position, and the path's length."""
    data = validated(energy_features(spark, sf_dir))
    fitted = mixture.fit(data, first_rows(data, 20), prior=priors.random_walk(20, D, 1, 10.0), model="EEI", max_iter=3, tol=-math.inf)
    order = fitted.ordering(data)
    return order.crossJoin(loss.path_loss(data, order).select(r4(F.col("loss")).alias("path_length")))


QUERIES["em_random_walk_order"] = flagship
ORACLES["em_random_walk_order"] = f"""WITH {sql_prior_em(3, 20, sql_walk_prior(20, 1, 10.0))}, z AS (SELECT id, any_value(x) AS x, arg_min(k, {{'g': -g, 'k': k}}) AS k FROM g2 GROUP BY id),
o AS (SELECT id, k::INT AS k, row_number() OVER (ORDER BY k, id) AS position, x, lag(x) OVER (ORDER BY k, id) AS y FROM z)
SELECT id, k, position, (SELECT round(sum(sqrt(list_sum(list_transform(range(1, 9), lambda j: (x[j] - y[j]) * (x[j] - y[j]))))), 4) FROM o) AS path_length FROM o"""

#: Of the trace: the mean log-likelihood, and the prior's part, which is much larger, by itself.
PRIOR_TRACE = """SELECT {0} AS iter, round(((SELECT sum(ln(exp(ll) + 1e-300)) FROM (SELECT DISTINCT id, ll FROM g{0})) + (SELECT -0.5 * sum(p.mu[j] * q.v * o.mu[j]) FROM prior q JOIN p{0} p ON p.k = r JOIN p{0} o ON o.k = c, range(1, 9) t(j))
 + 0.5 * 8 * (SELECT v FROM wd)) / (SELECT count(*) FROM f1), 4) AS objective"""


@query(f"WITH {sql_prior_em(3, 5, sql_var_prior(5))}, {sql_e(3)}, pd AS (SELECT 1 AS g, r, c, v FROM prior UNION ALL SELECT 1, r, 0, 0 FROM range(1, 6) a(r)), {sql_solve('d', 'pd', 5)} " + " UNION ALL ".join(PRIOR_TRACE.format(t) for t in (1, 2, 3)))
def em_prior_objective(spark, sf_dir):
    """The objective with the quadratic form and log-determinant of the prior."""
    data, f = prior_fit(spark, sf_dir, priors.var1(5, D, 0.8 * np.eye(D), 0.1 * np.eye(D)))
    return f.trace_frame(spark).select("iter", r4(F.col("objective") / F.lit(data.count())).alias("objective"))


@query(f"WITH {sql_prior_em(3, 5, sql_var_prior(5))} {LONG_PARAMS.format(3)}")
def em_var1_params(spark, sf_dir):
    _, f = prior_fit(spark, sf_dir, priors.var1(5, D, 0.8 * np.eye(D), 0.1 * np.eye(D)))
    return long_params(spark, f.params)


@query(f"WITH {sql_prior_em(3, 5, sql_walk_prior(5, 2, 10.0), True)} SELECT k::INT AS k, j::INT AS j, round(w, 4) AS weight, round(mu[j], 4) AS mean, round(v[j], 4) AS variance FROM p3 JOIN vk3 USING (k), range(1, 9) t(j)")
def em_unweighted_prior(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    f = mixture.fit(data, first_rows(data, 5), prior=priors.random_walk(5, D, 2, 10.0), model="VII", max_iter=3, tol=-math.inf, mean_update="unweighted", late_params=False)
    return long_params(spark, f.params)


BREAK_TOL = 0.5


@query(f"WITH {sql_prior_em(8, 5, sql_walk_prior(5, 2, 10.0), True)}, {sql_e(8, params='p{0} JOIN vk{0} USING (k)')}, pd AS (SELECT 1 AS g, r, c, v FROM prior UNION ALL SELECT 1, r, 0, 0 FROM range(1, 6) a(r)), {sql_solve('d', 'pd', 5)}, "
       + "tr AS (" + " UNION ALL ".join(PRIOR_TRACE.format(t).replace("round(", "(").replace(", 4) AS objective", ") * (SELECT count(*) FROM f1) AS objective") for t in range(1, 9)) + f"), st AS (SELECT coalesce(min(iter) FILTER (gain < {BREAK_TOL}), 9) AS iter FROM (SELECT iter, objective - lag(objective) OVER (ORDER BY iter) AS gain FROM tr)), "
       + "al AS (" + " UNION ALL ".join(f"SELECT {t} AS iter, k, w, mu, v FROM p{t} JOIN vk{t} USING (k)" for t in range(1, 9)) + ") SELECT k::INT AS k, j::INT AS j, round(w, 4) AS weight, round(mu[j], 4) AS mean, round(v[j], 4) AS variance FROM al, st, range(1, 9) t(j) WHERE al.iter = st.iter - 1")
def em_unweighted_break(spark, sf_dir):
    """A run that ends by its tolerance gives the parameters before its last update."""
    data = energy_features(spark, sf_dir)
    f = mixture.fit(data, first_rows(data, 5), prior=priors.random_walk(5, D, 2, 10.0), model="VII", max_iter=8, tol=BREAK_TOL, mean_update="unweighted", late_params=False)
    return long_params(spark, f.params)


@query()
def em_best_model(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    _, _, scores = mixture.best_model(data, first_rows(data, 5), max_iter=5)
    return spark.createDataFrame([(m, float(s)) for m, s in scores.items()], "model string, bic double")


# A prior over two components in one dimension: the normal equations of the means by Cramer's rule.
@query(f"""WITH f1 AS MATERIALIZED (SELECT vec_id AS id, [embedding[1]::DOUBLE] AS x FROM embeddings), {sql_start(2, d=1)}, {sql_e(0, d=1)},
s AS (SELECT sum(g) FILTER (k = 1) AS n1, sum(g) FILTER (k = 2) AS n2, sum(g * x[1]) FILTER (k = 1) AS a1, sum(g * x[1]) FILTER (k = 2) AS a2 FROM g0),
h AS (SELECT n1 / v[1] + 10 * (1 + 1e-6) AS h11, n2 / v[1] + 10 * (1 + 1e-6) AS h22, -10.0 AS h12, a1 / v[1] AS b1, a2 / v[1] AS b2 FROM s, v0)
SELECT k::INT AS k, round(CASE k WHEN 1 THEN b1 * h22 - h12 * b2 ELSE h11 * b2 - h12 * b1 END / (h11 * h22 - h12 * h12), 4) AS mean FROM h, range(1, 3) t(k)""")
def mstep_prior_means(spark, sf_dir):
    data = two_features(spark, sf_dir).withColumn("x", F.slice("x", 1, 1))
    start = first_rows(data, 2).cached()
    stats = mixture.statistics(data, start, True)
    p = mixture.m_step(stats, start, priors.random_walk(2, 1, 1, 10.0), "EEI")
    return spark.createDataFrame([(k + 1, float(p.mu[k, 0])) for k in range(2)], "k int, mean double").withColumn("mean", r4(F.col("mean")))


# Linear prior ---------------------------------------------------------------------------------------------------------------


def sql_linear(iterations: int, k: int = 5, precision: float = 1.0) -> str:
    centred = ", ".join(f"x[{j}] - (SELECT avg(x[{j}]) FROM f1)" for j in range(1, D + 1))
    out = [F1, f"c AS MATERIALIZED (SELECT id, [{centred}] AS x FROM f1)", f"b0 AS (SELECT [{', '.join(['0.1'] * D)}]::DOUBLE[] AS beta)"]
    t_of = f"-1 + 2.0 * (k - 1) / {k - 1}"
    out += [f"p0 AS MATERIALIZED (SELECT k, 1.0 / {k} AS w, {t_of} AS t, list_transform(beta, lambda b: b * ({t_of})) AS mu FROM b0, range(1, {k + 1}) r(k))", f"v0 AS (SELECT [{', '.join(['1.0'] * D)}]::DOUBLE[] AS v)"]
    for i in range(iterations):
        out.append(sql_e(i, "c"))
        beta = ", ".join(f"sum(t * g * x[{j}] / v[{j}]) / ({precision} + sum(g * t * t / v[{j}]))" for j in range(1, D + 1))
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT [{beta}] AS beta FROM g{i} JOIN p{i} USING (k), v{i})")
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT k, w, t, list_transform(beta, lambda b: b * t) AS mu FROM (SELECT k, sum(g) / (SELECT count(*) FROM f1) AS w, any_value(t) AS t FROM g{i} JOIN p{i} USING (k) GROUP BY k), b{i + 1})")
        v = ", ".join(f"sum(g * (x[{j}] - mu[{j}]) ** 2) / (SELECT count(*) FROM f1) + 1e-6 + 1e-8" for j in range(1, D + 1))
        out.append(f"v{i + 1} AS MATERIALIZED (SELECT [{v}] AS v FROM g{i} JOIN p{i + 1} USING (k))")
    return ",\n".join(out)


def linear_fit(spark, sf_dir, iterations):
    return linear.fit_linear(energy_features(spark, sf_dir), 5, 1.0, slope=np.full(D, 0.1), max_iter=iterations, tol=-math.inf)


def slope_frame(spark, f):
    return spark.createDataFrame([(j + 1, float(b), float(f.params.sigma[0, j, j])) for j, b in enumerate(f.slope)], "j int, slope double, variance double").select("j", r4(F.col("slope")).alias("slope"), r4(F.col("variance")).alias("variance"))


@query(f"WITH {sql_linear(1)} SELECT j::INT AS j, round(beta[j], 4) AS slope, round(v[j], 4) AS variance FROM b1, v1, range(1, 9) t(j)")
def linear_solve_slope(spark, sf_dir):
    return slope_frame(spark, linear_fit(spark, sf_dir, 1))


@query(f"WITH {sql_linear(2)} SELECT j::INT AS j, round(beta[j], 4) AS slope, round(v[j], 4) AS variance FROM b2, v2, range(1, 9) t(j)")
def linear_em_2iter(spark, sf_dir):
    return slope_frame(spark, linear_fit(spark, sf_dir, 2))


@query(f"WITH {sql_linear(2)} SELECT k::INT AS k, j::INT AS j, round(mu[j] + (SELECT avg(x[j]) FROM f1), 4) AS mean FROM p2, range(1, 9) t(j)")
def linear_means(spark, sf_dir):
    """The means come back uncentred."""
    return long_params(spark, linear_fit(spark, sf_dir, 2).params).select("k", "j", "mean")


@query(f"WITH {sql_linear(1)}, {sql_e(1, 'c')} SELECT 1 AS iter, round((sum(ln(greatest(exp(ll), 1e-300))) - 0.5 * any_value(list_sum(list_transform(beta, lambda b: b * b)))) / count(*), 4) AS objective FROM (SELECT DISTINCT id, ll FROM g1), b1")
def linear_objective(spark, sf_dir):
    f = linear_fit(spark, sf_dir, 1)
    return f.trace_frame(spark).withColumn("objective", r4(F.col("objective") / F.lit(energy_features(spark, sf_dir).count())))


# Priors ---------------------------------------------------------------------------------------------------------------------


PENALTY = """, u AS (SELECT vec_id % 6 + 1 AS g, e, avg(embedding[e]::DOUBLE) AS u FROM embeddings, range(1, {d} + 1) t(e) GROUP BY g, e)
SELECT ((q.i - 1) * {d} + a.e)::INT AS i, ((q.j - 1) * {d} + a.e)::INT AS j, round({v} * a.u * b.u, 6) AS value FROM q JOIN u a ON a.g = q.i JOIN u b ON b.g = q.j AND b.e = a.e WHERE v <> 0"""


def sql_walk(order: int, k: int, d: int, strength: float) -> str:
    coef = {1: "CASE c - r WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END", 2: "CASE c - r WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1 ELSE 0 END"}[order]
    return f"""WITH d AS (SELECT r, c, {coef} AS v FROM range(1, {k - order + 1}) a(r), range(1, {k + 1}) b(c)),
q AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) + CASE WHEN a.c = b.c THEN 1e-6 ELSE 0 END AS v FROM d a JOIN d b USING (r) GROUP BY a.c, b.c)
{PENALTY.format(d=d, v=f"{strength} * v")}"""


def penalty_terms(spark: SparkSession, sf_dir: str, prior) -> DataFrame:
    """Terms u_i Q_ij u_j of a prior over six components, at the means of six groups of rows in two features."""
    rows = two_features(spark, sf_dir).select((F.col("id") % 6).alias("g"), F.posexplode("x").alias("e", "v"))
    means = rows.groupBy("g", "e").agg(F.avg("v").alias("u")).select((F.col("g") * 2 + F.col("e") + 1).cast("int").alias("i"), "u")
    terms = priors.as_frame(spark, prior).join(means, "i").join(means.select(F.col("i").alias("j"), F.col("u").alias("w")), "j")
    return terms.select("i", "j", r4(F.col("value") * F.col("u") * F.col("w"), 6).alias("value"))


@query(sql_walk(1, 6, 2, 10.0))
def prior_rw1(spark, sf_dir):
    return penalty_terms(spark, sf_dir, priors.random_walk(6, 2, 1, 10.0))


@query(sql_walk(2, 6, 2, 400.0))
def prior_rw2(spark, sf_dir):
    return penalty_terms(spark, sf_dir, priors.random_walk(6, 2, 2, 400.0))


@query(f"""WITH q AS (SELECT i, j, CASE WHEN i = j THEN CASE WHEN i = 1 THEN 1.0 ELSE 10.0 END + CASE WHEN i < 6 THEN 6.4 ELSE 0 END
 WHEN abs(i - j) = 1 THEN -8.0 ELSE 0 END AS v FROM range(1, 7) a(i), range(1, 7) b(j))
{PENALTY.format(d=2, v="v::DOUBLE")}""")
def prior_var1(spark, sf_dir):
    return penalty_terms(spark, sf_dir, priors.var1(6, 2, 0.8 * np.eye(2), 0.1 * np.eye(2)))


@query(f"""WITH m AS (SELECT k, j, 10 * {DRAW.format("'3:mean:' || k || ':' || j")} - 5 AS mu FROM range(1, 6) a(k), range(1, 3) b(j)), r AS (SELECT id, 1 + floor({DRAW.format("'3:z:' || id")} * 5)::INT AS z FROM (SELECT o_orderkey AS id FROM orders)),
x AS (SELECT z, j, mu, mu + sqrt(0.1) * sqrt(-2 * ln(1 - {DRAW.format("'3:' || id || ':' || j || ':a'")})) * cos(2 * pi() * {DRAW.format("'3:' || id || ':' || j || ':b'")}) AS v FROM r JOIN m ON k = z)
SELECT z, j::INT AS j, count(*) AS n, round(any_value(mu), 4) AS mu, round(avg(v), 4) AS mean, round(var_samp(v), 4) AS variance FROM x GROUP BY z, j""")
def simulated_moments(spark, sf_dir):
    """A row drawn for each order, and the moments of what was drawn."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    rows, p = simulate.simulate_mixture(spark, 0, 5, 2, seed=3, ids=orders)
    true = p.as_frame(spark).select(F.col("k").alias("z"), F.posexplode("mu").alias("at", "mu"))
    got = rows.select("z", F.posexplode("x").alias("at", "v")).groupBy("z", "at").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))
    return got.join(true, ["z", "at"]).select("z", (F.col("at") + 1).alias("j"), "n", *[r4(F.col(c)).alias(c) for c in ("mu", "mean", "variance")])


# Threshold EM ---------------------------------------------------------------------------------------------------------------


def sql_hard(iterations: int, k: int) -> str:
    out = [F1, sql_start(k)]
    for t in range(iterations):
        mu = ", ".join(f"coalesce(avg(x[{j}]), (SELECT avg(x[{j}]) FROM f1))" for j in range(1, D + 1))
        v = ", ".join(f"var_samp(x[{j}] - mu[{j}])" for j in range(1, D + 1))
        out += [
            sql_e(t),
            f"z{t} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(k, {{'g': -g, 'k': k}}) AS k FROM g{t} GROUP BY id)",
            f"p{t + 1} AS MATERIALIZED (SELECT r.k, 1.0 / {k} AS w, [{mu}] AS mu FROM range(1, {k + 1}) r(k) LEFT JOIN z{t} USING (k) GROUP BY r.k)",
            f"v{t + 1} AS MATERIALIZED (SELECT [{v}] AS v FROM z{t} JOIN p{t + 1} USING (k))",
        ]
    return ",\n".join(out)


@query(f"WITH {sql_hard(2, 5)} {LONG_PARAMS.format(2)}")
def hard_threshold_means(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return long_params(spark, threshold.fit_threshold(data, first_rows(data, 5), smoothers.group_means(5), max_iter=2, tol=-1).params)


@query(f"WITH {F1}, {sql_start(5)}, {sql_e(0)} SELECT id, arg_min(k, {{'g': -g, 'k': k}})::INT AS k FROM g0 GROUP BY id")
def hard_assignment(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return threshold.assign(data, first_rows(data, 5))


@query(f"""WITH {F1}, {sql_start(5)}, {sql_e(0)}, c AS (SELECT id, k, sum(g) OVER (PARTITION BY id ORDER BY k) AS upto FROM g0)
SELECT id, least(5, 1 + count(*) FILTER (upto < {DRAW.format("'7:1:' || id")}))::INT AS k FROM c GROUP BY id""")
def stochastic_assignment(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return threshold.assign(data, first_rows(data, 5), seed=7)


def smoothed(spark, sf_dir, smoother, k=10, **options):
    data = energy_features(spark, sf_dir)
    return threshold.fit_threshold(data, first_rows(data, k), smoother, max_iter=5, **options).params


def sql_spline(iterations: int, k: int, count: int, smoothing: float) -> str:
    """Threshold EM with a cubic spline: the cardinal B-spline in closed form, squared second differences, normal equations by elimination."""
    u = f"(k - 1) / {k - 1}.0 * {count - 3} - (b - 1) + 3"
    piece = "CASE WHEN u < 0 OR u >= 4 THEN 0 WHEN u < 1 THEN u ** 3 WHEN u < 2 THEN -3 * (u - 1) ** 3 + 3 * (u - 1) ** 2 + 3 * (u - 1) + 1 WHEN u < 3 THEN 3 * (u - 2) ** 3 - 6 * (u - 2) ** 2 + 4 ELSE (4 - u) ** 3 END / 6.0"
    out = [F1, sql_start(k), f"bs AS MATERIALIZED (SELECT k, b, ({piece})::DOUBLE AS v FROM (SELECT k, b, {u} AS u FROM range(1, {k + 1}) r(k), range(1, {count + 1}) s(b)))"]
    out.append(f"df AS (SELECT r, c, CASE c - r WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1 ELSE 0 END AS v FROM range(1, {count - 1}) a(r), range(1, {count + 1}) b(c))")
    out.append("pen AS MATERIALIZED (SELECT a.c AS r, b.c AS c, sum(a.v * b.v)::DOUBLE AS v FROM df a JOIN df b USING (r) GROUP BY a.c, b.c)")
    for t in range(iterations):
        v = ", ".join(f"var_samp(x[{j}] - mu[{j}])" for j in range(1, D + 1))
        out += [
            sql_e(t), f"z{t} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(k, {{'g': -g, 'k': k}}) AS k FROM g{t} GROUP BY id)",
            f"gr{t} AS MATERIALIZED (SELECT a.b AS r, b.b AS c, sum(a.v * b.v * n) AS v FROM (SELECT k, count(*) AS n FROM z{t} GROUP BY k) JOIN bs a USING (k) JOIN bs b USING (k) GROUP BY a.b, b.b)",
            f"""a{t} AS MATERIALIZED (SELECT j AS g, r, c, g.v + {smoothing} * p.v + CASE WHEN r = c THEN 1e-10 * (SELECT sum(v) FROM gr{t} WHERE r = c) / {count} ELSE 0 END AS v FROM gr{t} g JOIN pen p USING (r, c), range(1, {D + 1}) d(j)
 UNION ALL SELECT j, b, 0, sum(bs.v * x[j]) FROM z{t} JOIN bs USING (k), range(1, {D + 1}) d(j) GROUP BY j, b)""",
            sql_solve(f"e{t}_", f"a{t}", count),
            f"p{t + 1} AS MATERIALIZED (SELECT k, 1.0 / {k} AS w, list(m ORDER BY j) AS mu FROM (SELECT k, u.g AS j, sum(bs.v * u.v) AS m FROM bs JOIN ue{t}_ u ON u.r = b GROUP BY k, u.g) GROUP BY k)",
            f"v{t + 1} AS MATERIALIZED (SELECT [{v}] AS v FROM z{t} JOIN p{t + 1} USING (k))",
        ]
    return ",\n".join(out)


@query(f"WITH {sql_spline(2, 10, 8, 1.0)} {LONG_PARAMS.format(2)}")
def spline_threshold_em_2iter(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return long_params(spark, threshold.fit_threshold(data, first_rows(data, 10), smoothers.penalised_spline(10, count=8, smoothing=1.0), max_iter=2, tol=-1).params)


@query()
def spline_threshold_em(spark, sf_dir):
    return long_params(spark, smoothed(spark, sf_dir, smoothers.penalised_spline(10, count=8, smoothing=1.0)))


@query()
def spline_threshold_em_ml(spark, sf_dir):
    return plotdata.mean_curves(smoothed(spark, sf_dir, smoothers.penalised_spline(10, count=8)), spark)


@query()
def wiener_threshold_em(spark, sf_dir):
    return plotdata.mean_curves(smoothed(spark, sf_dir, smoothers.wiener_process(10, prior_sd=0.5), threshold="stochastic"), spark)


# Tours, losses, selection ---------------------------------------------------------------------------------------------------


PAIRS = f"SELECT a.grp, a.id AS i, b.id AS j, {DIST} AS distance FROM {{0}} a JOIN {{0}} b ON a.id > b.id"


@query(f"WITH {F1} SELECT i, j, round(distance, 4) AS distance FROM ({PAIRS.format('f1')})")
def pairwise_distance(spark, sf_dir):
    return tours.pairwise(energy_features(spark, sf_dir), digits=4)


@query(f"WITH {F1} SELECT i AS start, j AS \"end\", round(distance, 4) AS distance FROM ({PAIRS.format('f1')}) ORDER BY distance DESC, j, i LIMIT 1")
def farthest_pair(spark, sf_dir):
    return tours.farthest_pair(energy_features(spark, sf_dir)).withColumn("distance", r4(F.col("distance")))


def sql_tour(src: str, method: str, tag: str = "") -> str:
    """CTEs for a tour in each grp of src(grp, id, x): done<tag>(grp, path of row numbers, loss), and the rows r<tag>(grp, id, i).

    Each row of distances is a list; a step takes one row number after the other with the lists of the rows it needs.
    """
    free = lambda n: f"list_transform(free, lambda f, q: f AND q <> {n})"
    only = lambda v, rest: f"list_transform({v}, lambda v, q: CASE WHEN free[q] THEN v ELSE {rest}::DOUBLE END)"
    out = [
        f"r{tag} AS MATERIALIZED (SELECT grp, id, x, row_number() OVER (PARTITION BY grp ORDER BY id) AS i, count(*) OVER (PARTITION BY grp) AS n FROM {src})",
        f"d{tag} AS MATERIALIZED (SELECT a.grp, a.i, any_value(a.n) AS n, list({DIST} ORDER BY b.i) AS row FROM r{tag} a JOIN r{tag} b ON a.grp = b.grp GROUP BY a.grp, a.i)",
        f"""s{tag} AS MATERIALIZED (SELECT grp, n, e.i AS a, e.j AS b, -e.d AS d FROM (SELECT grp, any_value(n) AS n, min({{'d': -row[j], 'j': j, 'i': i}}) AS e FROM (SELECT grp, n, i, row, unnest(range(1, i)) AS j FROM d{tag}) GROUP BY grp)
 UNION ALL SELECT grp, 1, 1, 1, 0 FROM d{tag} WHERE n = 1)""",
    ]
    if method == "nn":
        out.append(f"""t{tag} AS (SELECT grp, n, a AS at_, [a] AS path, list_transform(range(1, n + 1), lambda q: q <> a) AS free, 0.0::DOUBLE AS loss FROM s{tag} UNION ALL
 SELECT grp, n, nxt, list_append(path, nxt), {free('nxt')}, loss + m FROM (SELECT *, list_position(c, list_min(c)) AS nxt, list_min(c) AS m FROM (SELECT t.*, {only('d.row', "'inf'")} AS c FROM t{tag} t JOIN d{tag} d ON d.grp = t.grp AND d.i = t.at_ WHERE len(path) < t.n)))""")
    else:
        first = f"""SELECT s.grp, s.n, CASE WHEN s.n = 1 THEN [s.a] ELSE [s.a, s.b] END AS path, [s.d] AS seg, list_transform(range(1, s.n + 1), lambda q: q <> s.a AND q <> s.b) AS free, list_transform(x.row, lambda v, q: least(v, y.row[q])) AS near
 FROM s{tag} s JOIN d{tag} x ON x.grp = s.grp AND x.i = s.a JOIN d{tag} y ON y.grp = s.grp AND y.i = s.b"""
        cost = "list_transform(seg, lambda v, q: row[path[q]] + row[path[q + 1]] - v)"
        if method == "cheapest_insertion":
            pick = f"""SELECT grp, n, path, seg, free, near, e.i AS node FROM (SELECT grp, any_value(n) AS n, any_value(path) AS path, any_value(seg) AS seg, any_value(free) AS free, any_value(near) AS near, min({{'c': c, 'i': i}}) AS e
 FROM (SELECT t.*, d.i, list_min(list_transform(seg, lambda v, q: d.row[path[q]] + d.row[path[q + 1]] - v)) AS c FROM t{tag} t JOIN d{tag} d ON d.grp = t.grp AND t.free[d.i] WHERE len(path) < t.n) GROUP BY grp)"""
        else:
            best, rest = ("list_max", "'-inf'") if method == "farthest_insertion" else ("list_min", "'inf'")
            pick = f"SELECT *, list_position(c, {best}(c)) AS node FROM (SELECT *, {only('near', rest)} AS c FROM t{tag} WHERE len(path) < n)"
        out.append(f"""t{tag} AS ({first} UNION ALL
 SELECT grp, n, path[1 : at_] || [node] || path[at_ + 1 :], seg[1 : at_ - 1] || [row[path[at_]], row[path[at_ + 1]]] || seg[at_ + 1 :], {free('node')}, list_transform(near, lambda v, q: least(v, row[q]))
 FROM (SELECT *, list_position(k, list_min(k)) AS at_ FROM (SELECT z.grp, z.n, path, seg, free, near, node, d.row, {cost} AS k FROM ({pick}) z JOIN d{tag} d ON d.grp = z.grp AND d.i = z.node)))""")
    out.append(f"done{tag} AS MATERIALIZED (SELECT grp, path, {'loss' if method == 'nn' else 'list_sum(seg)'} AS loss FROM t{tag} WHERE len(path) = n)")
    return ",\n".join(out)


PLACES = "SELECT grp, path[pos] AS i, pos FROM (SELECT grp, path, unnest(range(1, len(path) + 1)) AS pos FROM done)"
ALL_ROWS = "f AS (SELECT id, 'all' AS grp, x FROM f1)"
IN_ALL = f"SELECT id, pos::INT AS position FROM ({PLACES}) JOIN r USING (grp, i)"


@query(f"WITH RECURSIVE {F1}, {ALL_ROWS}, {sql_tour('f', 'nn')} {IN_ALL}")
def nn_tour(spark, sf_dir):
    return tours.tour(energy_features(spark, sf_dir))


@query(f'WITH RECURSIVE {F1}, {sql_tour("f1", "nn")} SELECT grp AS "group", id, pos::INT AS position FROM ({PLACES}) JOIN r USING (grp, i)')
def nn_tour_grouped(spark, sf_dir):
    return tours.tour(energy_features(spark, sf_dir), group="grp")


def insertion_query(method):
    def run(spark, sf_dir):
        return tours.tour(energy_features(spark, sf_dir), method)

    return run


for _m in ("farthest_insertion", "nearest_insertion", "cheapest_insertion", "two_opt"):
    QUERIES[f"tour_{_m}"] = insertion_query(_m)
    if _m != "two_opt":
        ORACLES[f"tour_{_m}"] = f"WITH RECURSIVE {F1}, {ALL_ROWS}, {sql_tour('f', _m)} {IN_ALL}"


def id_order(data):
    return ordering.positions(data.select("id"), F.col("id"))


LAG = f"WITH {F1}, l AS (SELECT id, grp, {{0}} AS x, lag({{0}}) OVER (ORDER BY id) AS y FROM f1) SELECT round(sum({{1}}), 4) AS loss FROM l"
EUCLID = "sqrt(list_sum(list_transform(range(1, 9), lambda j: (x[j] - y[j]) * (x[j] - y[j]))))"


def lossy(spark, sf_dir, **options):
    data = energy_features(spark, sf_dir)
    return loss.path_loss(data, id_order(data), **options).select(r4(F.col("loss")).alias("loss"))


@query(LAG.format("x", EUCLID))
def path_loss(spark, sf_dir):
    return lossy(spark, sf_dir)


@query(LAG.format("list_transform(x, lambda v: v / list_sum(x))", EUCLID))
def path_loss_normalised(spark, sf_dir):
    return lossy(spark, sf_dir, normalise=True)


@query(LAG.format("x", "list_sum(list_transform(range(1, 9), lambda j: abs(x[j] - y[j])))"))
def path_loss_l1(spark, sf_dir):
    return lossy(spark, sf_dir, distance=manhattan)


@query(LAG.format("x", "list_max(list_transform(range(1, 9), lambda j: abs(x[j] - y[j])))"))
def path_loss_python(spark, sf_dir):
    """A distance that is given as a Python function: the largest difference of an entry."""
    return lossy(spark, sf_dir, distance=from_python(lambda a, b: np.abs(a - b).max()))


@query(LAG.format("x", "1 - list_sum(list_transform(range(1, 9), lambda j: x[j] * y[j])) / sqrt(list_sum(list_transform(x, lambda v: v * v)) * list_sum(list_transform(y, lambda v: v * v)))"))
def path_loss_cosine(spark, sf_dir):
    return lossy(spark, sf_dir, distance=cosine)


GROUP_LOSS = f"""WITH {F1}, l AS (SELECT id, grp, x, lag(x) OVER (PARTITION BY grp ORDER BY id) AS y FROM f1),
g AS (SELECT grp, count(*) AS n, coalesce(sum({EUCLID}), 0) AS loss FROM l GROUP BY grp) """


def group_order(data):
    return ordering.local_positions(data.select("id", F.col("grp").alias("group")), "group", F.col("id"))


@query(GROUP_LOSS + 'SELECT grp AS "group", n, round(loss, 4) AS loss FROM g')
def path_loss_by_group(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return loss.group_losses(data, group_order(data)).select("group", "n", r4(F.col("loss")).alias("loss"))


@query(GROUP_LOSS + "SELECT round(avg(loss), 4) AS loss FROM g")
def path_loss_grouped(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return loss.grouped_loss(data, group_order(data)).select(r4(F.col("loss")).alias("loss"))


@query(GROUP_LOSS + "SELECT round(sum(loss * n) / sum(n), 4) AS loss FROM g")
def path_loss_grouped_weighted(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return loss.grouped_loss(data, group_order(data), weighted=True).select(r4(F.col("loss")).alias("loss"))


def sql_selection(by_group: bool, method: str) -> str:
    """All columns, the first one first: each level makes the tours of every column that is left, and keeps the shortest."""
    parts = [F1, "c1 AS (SELECT [1] AS cols, 1 AS c)"]
    for t in range(1, D + 1):
        if t > 1:
            parts.append(f"c{t} AS MATERIALIZED (SELECT list_append(cols, r) AS cols, r AS c FROM b{t - 1}, range(1, {D + 1}) q(r) WHERE NOT list_contains(cols, r))")
        parts.append(f"y{t} AS MATERIALIZED (SELECT {{'c': c, 'g': {'grp' if by_group else chr(39) + 'all' + chr(39)}}} AS grp, id, list_transform(cols, lambda k: x[k]) AS x FROM f1, c{t})")
        parts.append(sql_tour(f"y{t}", method, f"{t}"))
        parts.append(f"l{t} AS (SELECT grp.c AS c, avg(loss) AS loss FROM done{t} GROUP BY grp.c)")
        parts.append(f"b{t} AS MATERIALIZED (SELECT e.cols AS cols, e.c AS c, e.l AS loss FROM (SELECT min({{'l': loss, 'c': c, 'cols': cols}}) AS e FROM l{t} JOIN c{t} USING (c)))")
    return f"WITH RECURSIVE {', '.join(parts)} "


STEPS = " UNION ALL ".join(f"SELECT {t}::INT AS step, {{0}} FROM b{t}" for t in range(1, D + 1))


@query(sql_selection(False, "nn") + STEPS.format("c::INT AS factor, round(loss, 4) AS loss"))
def factor_selection_nn(spark, sf_dir):
    return selection.forward_selection(energy_features(spark, sf_dir), method="nn").withColumn("loss", r4(F.col("loss")))


@query(sql_selection(True, "nn") + STEPS.format("c::INT AS factor, round(loss, 4) AS loss"))
def factor_selection_grouped(spark, sf_dir):
    return selection.grouped_forward_selection(energy_features(spark, sf_dir), "grp", method="nn").withColumn("loss", r4(F.col("loss")))


@query(sql_selection(True, "nn").replace("avg(loss) AS loss FROM done", "sum(loss * len(path)) / sum(len(path)) AS loss FROM done") + STEPS.format("c::INT AS factor, round(loss, 4) AS loss"))
def factor_selection_weighted(spark, sf_dir):
    return selection.grouped_forward_selection(energy_features(spark, sf_dir), "grp", method="nn", weighted=True).withColumn("loss", r4(F.col("loss")))


@query(sql_selection(False, "farthest_insertion") + STEPS.format("round(loss, 4) AS loss, c::VARCHAR AS label"))
def factor_selection_elbow(spark, sf_dir):
    return selection.elbow_table(selection.forward_selection(energy_features(spark, sf_dir))).withColumn("loss", r4(F.col("loss")))


# Samples, tables for plots, notebook steps ----------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer ORDER BY md5('1:' || c_custkey::VARCHAR), c_custkey LIMIT 100")
def row_sample(spark, sf_dir):
    return sampling.sample_rows(read_table(spark, sf_dir, "customer").select("c_custkey"), 100, 1, "c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1:' || c_custkey::VARCHAR), c_custkey) <= 50")
def stratified_sample(spark, sf_dir):
    return sampling.sample_strata(read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 50, 1, "c_custkey")


@query(f"WITH {F1} SELECT row_number() OVER (PARTITION BY j ORDER BY id) AS x, 'loading' || j AS \"Component\", round(x[j], 4) AS \"Value\" FROM f1, range(1, 9) t(j) WHERE j IN (1, 3)")
def structure_long(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return plotdata.structure_by_order(data, id_order(data), [1, 3]).withColumn("Value", r4(F.col("Value")))


@query(f"""WITH {F1}, f AS (SELECT *, min(id) OVER (PARTITION BY grp) AS first_id FROM f1)
SELECT row_number() OVER (PARTITION BY j ORDER BY first_id, id) AS x, grp AS "Group", 'loading' || j AS "Component", round(x[j], 4) AS "Value" FROM f, range(1, 9) t(j)""")
def structure_long_grouped(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return plotdata.structure_by_group(data, group_order(data)).withColumn("Value", r4(F.col("Value")))


@query(f"WITH {F1} SELECT id AS \"Sample\", row_number() OVER (PARTITION BY j ORDER BY id) AS position, 'Factor' || j AS \"Factor\", round(x[j], 4) AS \"Loading\" FROM f1, range(1, 9) t(j)")
def structure_by_sample(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    return plotdata.structure_by_id(data, id_order(data)).withColumn("Loading", r4(F.col("Loading")))


EVENT_TYPES = """n AS (SELECT user_id AS id, event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT id, arg_min(event_type, {'n': -n, 't': event_type}) AS type FROM n GROUP BY id),
m AS (SELECT user_id AS id, avg(value) AS metric FROM events GROUP BY user_id)"""


def event_types(spark, sf_dir):
    """(id, type): each user's most frequent event type; (id, metric): the mean value."""
    events = read_table(spark, sf_dir, "events")
    n = events.groupBy(F.col("user_id").alias("id"), "event_type").agg(F.count("*").alias("n"))
    types = n.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("event_type").alias("type"))).alias("b")).select("id", "b.type")
    return types, events.groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("metric"))


def metric_order(spark, sf_dir):
    """Users by their mean value. Means are exact: those that tie are told apart by id, not by what rounding left of sums in some order."""
    means = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(exact_mean("value").alias("metric"))
    return ordering.by_metric(means, "metric")


SOME_TYPES = ["click", "view"]


@query(f"""WITH {EVENT_TYPES}, j AS (SELECT m.id AS "Sample", metric, type FROM m JOIN t USING (id))
SELECT "Sample", round(metric, 4) AS "Metric", type AS "Type", CASE WHEN type IN ('click', 'view') THEN type ELSE 'Other' END AS "Highlight",
 round((SELECT (max(metric) - min(metric)) / count(*) FROM j), 4) AS width FROM j""")
def highlight_types(spark, sf_dir):
    types, metric = event_types(spark, sf_dir)
    return plotdata.highlighted_types(types, SOME_TYPES, metric=metric).withColumn("Metric", r4(F.col("Metric"))).withColumn("width", r4(F.col("width")))


@query(f"""WITH {EVENT_TYPES}, j AS (SELECT m.id, row_number() OVER (ORDER BY metric, m.id) / (SELECT count(*) FROM m)::DOUBLE AS metric, type FROM m JOIN t USING (id))
SELECT id AS "Sample", round(metric, 4) AS "Metric", type AS "Type", CASE WHEN type IN ('click', 'view') THEN type ELSE 'Other' END AS "Highlight",
 round(1.0 / (SELECT count(*) FROM j), 4) AS width FROM j""")
def highlight_types_by_order(spark, sf_dir):
    types, _ = event_types(spark, sf_dir)
    order = metric_order(spark, sf_dir)
    return plotdata.highlighted_types(types, SOME_TYPES, order=order).withColumn("Metric", r4(F.col("Metric"))).withColumn("width", r4(F.col("width")))


@query(f"""WITH {EVENT_TYPES} SELECT type AS "Type", count(*) AS n, round(avg(metric), 4) AS mean, round(stddev_samp(metric), 4) AS sd, round(min(metric), 4) AS least,
 round(quantile_cont(metric, 0.25), 4) AS q1, round(median(metric), 4) AS median, round(quantile_cont(metric, 0.75), 4) AS q3, round(max(metric), 4) AS most
FROM m JOIN t USING (id) WHERE type IN ('click', 'view') GROUP BY type""")
def distribution_summary(spark, sf_dir):
    types, metric = event_types(spark, sf_dir)
    got = plotdata.type_summary(types, SOME_TYPES, metric=metric)
    return got.select("Type", "n", *[r4(F.col(c)).alias(c) for c in ("mean", "sd", "least", "q1", "median", "q3", "most")])


@query(f"""WITH {EVENT_TYPES}, j AS (SELECT type, metric FROM m JOIN t USING (id) WHERE type IN ('click', 'view')), g AS (SELECT 500.0 * i / 20 AS at_ FROM range(0, 21) r(i))
SELECT type AS "Type", at_::DOUBLE AS "at", round(avg(exp(-0.5 * ((at_ - metric) / 20.0) ** 2) / (20.0 * sqrt(2 * pi()))), 6) AS density FROM j, g GROUP BY type, at_""")
def distribution_kde(spark, sf_dir):
    types, metric = event_types(spark, sf_dir)
    return plotdata.type_density(types, SOME_TYPES, metric=metric, points=21, bandwidth=20.0, span=(0.0, 500.0)).withColumn("density", r4(F.col("density"), 6))


@query(f"""WITH {EVENT_TYPES}, j AS (SELECT type, metric FROM m JOIN t USING (id) WHERE type IN ('click', 'view')), s AS (SELECT min(metric) AS a, max(metric) AS z FROM j), g AS (SELECT i, a + (z - a) * i / 10 AS at_ FROM s, range(0, 11) r(i)),
q AS (SELECT type, count(*) AS n, stddev_samp(metric) AS sd, (quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25)) / 1.34 AS iqr FROM j GROUP BY type),
b AS (SELECT type, 0.9 * CASE WHEN iqr > 0 AND iqr < sd THEN iqr ELSE sd END * n ** -0.2 AS h FROM q)
SELECT j.type AS "Type", round(at_, 4) AS "at", round(avg(exp(-0.5 * ((at_ - metric) / h) ** 2) / (h * sqrt(2 * pi()))), 6) AS density FROM j JOIN b USING (type), g GROUP BY j.type, i, at_""")
def distribution_kde_default(spark, sf_dir):
    """Over the range of the metric, with each type's own bandwidth."""
    types, metric = event_types(spark, sf_dir)
    got = plotdata.type_density(types, SOME_TYPES, metric=metric, points=11)
    return got.select("Type", r4(F.col("at")).alias("at"), r4(F.col("density"), 6).alias("density"))


@query(f"""WITH {EVENT_TYPES}, j AS (SELECT type, metric FROM m JOIN t USING (id) WHERE type IN ('click', 'view')),
q AS (SELECT type, count(*) AS n, min(metric) AS a, max(metric) AS z, stddev_samp(metric) AS sd, (quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25)) / 1.34 AS iqr FROM j GROUP BY type),
b AS (SELECT type, a, z, 0.9 * CASE WHEN iqr > 0 AND iqr < sd THEN iqr ELSE sd END * n ** -0.2 AS h FROM q),
g AS (SELECT type, h, i, a - 3 * h + i * (z - a + 6 * h) / 40 AS at_ FROM b, range(0, 41) r(i) WHERE h > 0),
d AS (SELECT type, i, at_, avg(exp(-0.5 * ((at_ - metric) / h) ** 2) / (h * sqrt(2 * pi()))) AS density FROM j JOIN g USING (type) GROUP BY type, i, at_)
SELECT type AS "Type", i::INT AS i, round(at_, 4) AS "at", round(density, 6) AS density, round(density / max(density) OVER (), 4) AS width FROM d""")
def distribution_violin(spark, sf_dir):
    """Untrimmed outlines of the metric by type, each on its own grid."""
    types, metric = event_types(spark, sf_dir)
    got = plotdata.type_violin(types, SOME_TYPES, metric=metric, points=41)
    return got.select("Type", "i", r4(F.col("at")).alias("at"), r4(F.col("density"), 6).alias("density"), r4(F.col("width")).alias("width"))


@query(f"""WITH {EVENT_TYPES} SELECT id AS "Sample", round(metric, 4) AS "Metric", type AS "Type", round((2 * (('0x' || substr(md5('1:' || id), 1, 8))::BIGINT / 4294967296.0) - 1) * 0.1, 6) AS "offset"
FROM m JOIN t USING (id) WHERE type IN ('click', 'view')""")
def distribution_points(spark, sf_dir):
    """The points over the outlines, moved aside by a hash."""
    types, metric = event_types(spark, sf_dir)
    return plotdata.type_points(types, SOME_TYPES, metric=metric).withColumn("Metric", r4(F.col("Metric"))).withColumn("offset", r4(F.col("offset"), 6))


@query("WITH " + sql_em(3, 5) + ", n AS (SELECT k, mu AS a, lead(mu) OVER (ORDER BY k) AS b FROM p3) SELECT k::INT AS k, j::INT AS j, round(a[j], 4) AS start, round(b[j], 4) AS stop FROM n, range(1, 9) t(j) WHERE b IS NOT NULL AND sqrt(list_sum(list_transform(range(1, 9), lambda i: (a[i] - b[i]) ** 2))) > 1e-6")
def mean_path_segments(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    p = mixture.fit(data, first_rows(data, 5), model="EEI", max_iter=3, tol=-math.inf).params
    got = plotdata.path_segments(p, spark).select("k", F.posexplode(F.arrays_zip("from", "to")).alias("j", "s"))
    return got.select("k", (F.col("j") + 1).alias("j"), r4(F.col("s.from")).alias("start"), r4(F.col("s.to")).alias("stop"))


@query("WITH " + sql_em(3, 5) + " SELECT round((k - 1) / 4.0::DOUBLE, 4) AS location, j::INT AS dimension, round(mu[j], 4) AS mean FROM p3, range(1, 9) t(j)")
def mean_curves(spark, sf_dir):
    data = energy_features(spark, sf_dir)
    p = mixture.fit(data, first_rows(data, 5), model="EEI", max_iter=3, tol=-math.inf).params
    return plotdata.mean_curves(p, spark).select(r4(F.col("location")).alias("location"), "dimension", r4(F.col("mean")).alias("mean"))


@query(f"WITH {F1} SELECT i::INT AS i, j::INT AS j, round(covar_samp(x[i], x[j]), 6) AS value FROM f1, range(1, 9) a(i), range(1, 9) b(j) GROUP BY i, j")
def pca_covariance(spark, sf_dir):
    _, c, _ = ordering.covariance_matrix(energy_features(spark, sf_dir))
    return spark.createDataFrame([(i + 1, j + 1, float(c[i, j])) for i in range(D) for j in range(D)], "i int, j int, value double").withColumn("value", r4(F.col("value"), 6))


# A symmetric matrix squared many times over tends to its leading eigenvector's square; what is left without it gives the next one.
MATRIX = "list_transform(range(1, 9), lambda i: list_transform(range(1, 9), lambda j: {0}))"


def sql_leading(tag: str, src: str) -> str:
    """CTEs for the leading eigenvector of src(m): l<tag>(v, value)."""
    return f"""w{tag} AS (SELECT 0 AS n, m FROM {src} UNION ALL SELECT n + 1, {MATRIX.format('m[i][j] / t')} FROM (SELECT n, m, list_sum(list_transform(range(1, 9), lambda i: m[i][i])) AS t FROM
 (SELECT n, {MATRIX.format('list_sum(list_transform(range(1, 9), lambda l: m[i][l] * m[l][j]))')} AS m FROM w{tag} WHERE n < 50))),
z{tag} AS (SELECT m, list_transform(range(1, 9), lambda i: m[i][i]) AS e FROM w{tag} WHERE n = 50),
v{tag} AS (SELECT list_transform(range(1, 9), lambda i: m[i][list_position(e, list_max(e))] / sqrt(list_max(e))) AS v FROM z{tag}),
l{tag} AS MATERIALIZED (SELECT list_transform(v, lambda a: a / sqrt(list_sum(list_transform(v, lambda b: b * b)))) AS v FROM v{tag})"""


PCA = f"""WITH RECURSIVE {F1}, c0 AS (SELECT i, j, covar_samp(x[i], x[j]) AS v FROM f1, range(1, 9) a(i), range(1, 9) b(j) GROUP BY i, j),
c AS MATERIALIZED (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS row FROM c0 GROUP BY i)), {sql_leading('a', 'c')},
r AS MATERIALIZED (SELECT {MATRIX.format("m[i][j] - v[i] * v[j] * list_sum(list_transform(range(1, 9), lambda p: v[p] * list_sum(list_transform(range(1, 9), lambda q: m[p][q] * v[q]))))")} AS m FROM c, la), {sql_leading('b', 'r')} """


@query(PCA + """, s AS (SELECT id, list_sum(list_transform(range(1, 9), lambda j: x[j] * v[j])) AS s FROM f1, la)
SELECT id, round(s - (SELECT avg(s) FROM s), 4) AS metric, row_number() OVER (ORDER BY s, id) AS position FROM s""")
def pc1_order(spark, sf_dir):
    return ordering.by_metric(ordering.pc_scores(energy_features(spark, sf_dir)), "metric").withColumn("metric", r4(F.col("metric")))


@query(PCA + "SELECT j::INT AS j, round((SELECT avg(x[j]) FROM f1), 4) AS center, round(la.v[j], 4) AS pc1, round(lb.v[j], 4) AS pc2 FROM la, lb, range(1, 9) t(j)")
def pc_rotation(spark, sf_dir):
    mean, v = ordering.principal_components(energy_features(spark, sf_dir), 2)
    got = spark.createDataFrame([(j + 1, float(mean[j]), float(v[j, 0]), float(v[j, 1])) for j in range(D)], "j int, center double, pc1 double, pc2 double")
    return got.select("j", *[r4(F.col(c)).alias(c) for c in ("center", "pc1", "pc2")])


@query(f"""WITH {F1} SELECT id, rank, neighbour, round(d, 4) AS distance FROM (SELECT a.id, b.id AS neighbour, {DIST} AS d,
 row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id)::INT AS rank FROM f1 a JOIN f1 b ON a.id <> b.id) WHERE rank <= 15""")
def knn_graph(spark, sf_dir):
    return embed.neighbours(energy_features(spark, sf_dir), 15).withColumn("distance", r4(F.col("distance")))


@query()
def tsne_order(spark, sf_dir):
    return embed.tsne(energy_features(spark, sf_dir))


@query()
def umap_order(spark, sf_dir):
    return embed.umap_axis(energy_features(spark, sf_dir))


@query()
def hierarchical_single(spark, sf_dir):
    return embed.hierarchical(energy_features(spark, sf_dir), "single")


@query()
def hierarchical_ward(spark, sf_dir):
    return embed.hierarchical(energy_features(spark, sf_dir), "ward")


# The heights of single linkage are the edges of the minimum spanning tree: grown here from the first row, by each row's distance to the tree.
@query(f"""WITH RECURSIVE {F1}, {ALL_ROWS}, r AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY id) AS i FROM f), e AS MATERIALIZED (SELECT a.i, list({DIST} ORDER BY b.i) AS row FROM r a, r b GROUP BY a.i),
t AS (SELECT 1 AS n, NULL::DOUBLE AS d, list_transform(row, lambda v, q: CASE WHEN q = 1 THEN 'inf'::DOUBLE ELSE v END) AS reach FROM e WHERE i = 1 UNION ALL
 SELECT n + 1, d, list_transform(reach, lambda v, q: CASE WHEN v = 'inf'::DOUBLE OR q = i THEN 'inf'::DOUBLE ELSE least(v, row[q]) END) FROM
 (SELECT t.n, list_min(reach) AS d, reach, e.i, e.row FROM t JOIN e ON e.i = list_position(reach, list_min(reach)) WHERE t.n < (SELECT count(*) FROM r)))
SELECT row_number() OVER (ORDER BY d)::INT AS step, round(d, 4) AS height FROM t WHERE d IS NOT NULL""")
def merge_heights_single(spark, sf_dir):
    return embed.merge_heights(energy_features(spark, sf_dir), "single").withColumn("height", r4(F.col("height")))


@query("SELECT c_custkey AS id, c_mktsegment AS type, round(c_acctbal, 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def batch_filter(spark, sf_dir):
    """Rows of one batch, some columns, with their labels by a join."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    one = nation.where(F.col("n_name") == nation.agg(F.min("n_name")).first()[0])
    rows = read_table(spark, sf_dir, "customer").join(F.broadcast(one), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.round("c_acctbal", 2).alias("balance"))


@query("SELECT DISTINCT c_mktsegment AS type FROM customer")
def distinct_types(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("type")).distinct()


@query("""WITH u AS (SELECT user_id AS id, avg(value) AS metric FROM events GROUP BY user_id)
SELECT id, row_number() OVER (ORDER BY metric, id) AS position, round(row_number() OVER (ORDER BY metric, id) / (SELECT count(*) FROM u)::DOUBLE, 4) AS rank FROM u""")
def rank_metric(spark, sf_dir):
    return ordering.rank_metric(metric_order(spark, sf_dir).select("id", "position")).select("id", "position", r4(F.col("metric")).alias("rank"))


LINE = """f AS MATERIALIZED (SELECT [l_quantity / 50, l_extendedprice / 1e5, l_discount * 10, l_tax * 10]::DOUBLE[] AS x, row_number() OVER () AS id FROM lineitem)"""


def line_start(k: int = 20) -> Params:
    return mixture.isotropic(np.full(k, 1 / k), np.linspace(0.05, 0.95, k)[:, None] * np.ones(4), 0.05)


@query(f"""WITH {LINE}, p0 AS (SELECT k, 1.0 / 20 AS w, list_transform([1.0, 1, 1, 1], lambda u: u * (0.05 + 0.9 * (k - 1) / 19))::DOUBLE[] AS mu FROM range(1, 21) r(k)), v0 AS (SELECT [0.05, 0.05, 0.05, 0.05]::DOUBLE[] AS v),
{sql_e(0, 'f', 4)} SELECT k::INT AS k, round(sum(g) / (SELECT count(*) FROM f), 4) AS weight, round(sum(g * x[1]) / sum(g), 4) AS m1, round(sum(g * x[2]) / sum(g), 4) AS m2 FROM g0 GROUP BY k""")
def em_statistics_lineitem(spark, sf_dir):
    """One E-step and its sums over every line item."""
    rows = lineitem_features(spark, sf_dir)
    s = mixture.statistics(rows, line_start(), True, np.zeros(4))
    out = [(k + 1, float(s.weight[k] / s.n), *map(float, s.first[k, :2] / s.weight[k])) for k in range(20)]
    return spark.createDataFrame(out, "k int, weight double, m1 double, m2 double").select("k", *[r4(F.col(c)).alias(c) for c in ("weight", "m1", "m2")])
