"""Tours without a table of distances: the paths of the plain methods, and more rows than a table takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import routes, selection, tours


def tables():
    rng = np.random.default_rng(0)
    return [
        rng.standard_normal((300, 8)) ** 2, rng.integers(0, 4, (200, 2)).astype(float), rng.standard_normal((200, 1)), np.round(rng.uniform(-1, 1, (200, 1)), 1),
        rng.standard_normal((200, 3)) + 1e5, rng.standard_normal((200, 2)) * 1e-9, np.repeat(rng.standard_normal((40, 3)), 5, axis=0), rng.standard_normal((300, 2)) ** 3,
        np.ones((40, 2)), np.zeros((5, 1)), *(rng.standard_normal((n, 2)) for n in range(4)),
    ]


@pytest.mark.parametrize("method", tours.METHODS)
def test_paths_are_those_of_a_table_of_distances(method):
    for x in tables():
        assert routes.route(x, method) == tours.open_path(x, method)


def many(spark, n):
    return spark.range(n).select("id", F.array(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / 2.0**20, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) / 2.0**20).alias("x"), F.lit("g").alias("grp"))


@pytest.mark.parametrize("method", tours.METHODS)
def test_a_tour_takes_more_rows_than_a_table_of_distances(spark, method):
    n = tours.MOST + 1
    got = tours.tour(many(spark, n), method, group="grp").collect()
    assert sorted(r["id"] for r in got) == list(range(n)) and sorted(r["position"] for r in got) == list(range(1, n + 1))


def test_selection_takes_more_rows_than_a_table_of_distances(spark):
    rows = many(spark, tours.MOST + 1)
    for got in (selection.forward_selection(rows), selection.forward_selection(rows, method="nn"), selection.grouped_forward_selection(rows, "grp", weighted=True)):
        assert [r["step"] for r in got.orderBy("step").collect()] == [1, 2]


def test_tours_of_groups_are_not_joined_into_one_task(spark):
    rows = many(spark, 400).withColumn("grp", F.col("id") % 16)
    got = tours.tour(rows, "nn", group="grp").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 400 and len({r["task"] for r in got}) > 1
