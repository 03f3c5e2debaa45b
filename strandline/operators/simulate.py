"""Simulated mixtures with known parameters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixture import Params, drawn, isotropic

VARIANCE = 0.1


def draw(*parts: object) -> Column:
    """A number in 0..1 for each row, like ``mixture.drawn``: the same whatever the partitions, and when a task runs again."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / 2.0**52


def simulate_mixture(spark: SparkSession, n: int, k: int, d: int, seed: int = 1, projection: np.ndarray | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, Params]:
    """n rows, or one for each id of a table: id, x, z (from 1) and the true parameters: equal weights, means uniform in (-5, 5)^d (projected, if asked for), variance 0.1.

    Draws are hashes of the seed and the row's id; normal ones come from pairs of them (Box & Muller 1958).
    """
    mu = np.array([[10 * drawn(seed, "mean", i + 1, j + 1) - 5 for j in range(d)] for i in range(k)])
    if projection is not None:
        mu = mu @ np.asarray(projection, float).T
    means = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in mu])
    ids = spark.range(0, n, 1, max(1, n // 1_000_000)) if ids is None else ids.select("id")
    rows = ids.withColumn("z", (F.floor(draw(seed, "z", F.col("id")) * k) + 1).cast("int"))
    normal = lambda j: F.sqrt(-2 * F.log(1 - draw(seed, F.col("id"), j, "a"))) * F.cos(2 * math.pi * draw(seed, F.col("id"), j, "b"))
    rows = rows.withColumn("noise", F.array(*[normal(j + 1) * math.sqrt(VARIANCE) for j in range(d)]))
    x = F.zip_with(F.element_at(means, F.col("z")), "noise", lambda m, e: m + e)
    return rows.select("id", x.alias("x"), "z"), isotropic(np.full(k, 1 / k), mu, VARIANCE)
