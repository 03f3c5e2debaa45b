"""Means by exact sums: users with the same values tie, however the rows are cut."""

import numpy as np
from pyspark.sql import functions as F

from strandline.functions.means import exact_mean
from strandline.plans.catalogue import QUERIES


def test_users_with_the_same_values_go_by_id(spark, tmp_path):
    """Copies of a user, each with the rows in another order and over several files."""
    rng = np.random.default_rng(1)
    values = np.round(rng.uniform(0, 200, 60), 2)
    rows = [(u, float(v)) for u in range(40) for v in rng.permutation(values)]
    spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "user_id bigint, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["rank_metric"](spark, str(tmp_path)).orderBy("position").collect()
    assert [r["id"] for r in got] == list(range(40))


def test_means_of_odd_values(spark):
    rows = [("a", 0.1), ("a", 0.2), ("b", None), ("c", float("nan")), ("c", 1.0), ("d", 1e300), ("e", 1.0), ("e", None), ("f", 1e-30), ("g", float("inf"))]
    got = {r["g"]: r["m"] for r in spark.createDataFrame(rows, "g string, v double").groupBy("g").agg(exact_mean("v").alias("m")).collect()}
    assert got["a"] == 0.3 / 2 and got["b"] is None and np.isnan(got["c"]) and got["d"] == 1e300 and got["e"] == 1 and got["f"] == 1e-30 and got["g"] == float("inf")
    assert spark.range(0).select(F.col("id").cast("double").alias("v")).agg(exact_mean("v").alias("m")).first()["m"] is None
