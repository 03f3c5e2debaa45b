"""Orderings: by component, by metric, by principal component; positions count from 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, total, vector
from ..functions.names import spare
from ..sources.staging import materialise
from .graph import SALTS


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """df with dense positions 1..n in the given order, without moving all rows to one task.

    Rows are range-partitioned, sorted and written with their place in their partition; a partition's first position is the number
    of rows before it, from a table of one row for each partition that is joined by broadcast.
    """
    part, at, first = (spare(df, c) for c in ("__part", "__at", "__before"))
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    spread = spread.withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("bigint"), 33))
    spread = materialise(spread, "positions")
    before, upto = [], 0
    for r in sorted(spread.groupBy(part).count().collect()):
        before.append((r[part], upto))
        upto += r["count"]
    offsets = df.sparkSession.createDataFrame(before, f"{part} int, {first} bigint")
    placed = spread.join(F.broadcast(offsets), part)
    return placed.withColumn(name, (F.col(first) + F.col(at) + 1).cast("bigint")).drop(part, at, first)


def by_component(data: DataFrame, gamma: str = "gamma", id_col: str = "id") -> DataFrame:
    """id, k, position: most likely component (the first of equals), rows of a component by id."""
    rows = data.select(id_col, argmax(F.col(gamma)).alias("k"))
    return positions(rows, F.col("k"), F.col(id_col))


def by_metric(data: DataFrame, metric: str, id_col: str = "id") -> DataFrame:
    return positions(data.select(id_col, metric), F.col(metric), F.col(id_col))


def rank_metric(order: DataFrame) -> DataFrame:
    """order with metric = position / n."""
    n = order.count()
    return order.withColumn("metric", F.col("position") / F.lit(n))


def covariance_matrix(data: DataFrame, sample: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Column means, covariances (over n - 1, or n) and n, by one pass of sufficient statistics."""
    from .mixture import column_summary, isotropic, statistics

    mean = column_summary(data)["mean"]
    s = statistics(data, isotropic([1.0], mean[None], 1.0), False, mean)
    return mean, s.scatter(mean[None])[0] / max(1, s.n - sample), s.n


def principal_components(data: DataFrame, count: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Column means, and the first rotation vectors as columns; each has its largest entry (in size) positive."""
    mean, cov, _ = covariance_matrix(data)
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, ::-1][:, :count]
    return mean, v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def pc_scores(data: DataFrame, component: int = 1, name: str = "metric") -> DataFrame:
    """data with the centred score on a principal component."""
    mean, v = principal_components(data, component)
    w = v[:, component - 1]
    return data.withColumn(name, total(F.zip_with("x", vector(w), lambda a, b: a * b)) - F.lit(float(mean @ w)))


def local_positions(df: DataFrame, group: str, *order: Column, name: str = "position") -> DataFrame:
    """Positions inside each group: those over (group, order) less the group's first, so a group of any size is sorted by many tasks."""
    key, first, salt = (spare(df, c) for c in ("__group", "__first", "__salt"))
    placed = positions(df.withColumn(salt, F.lit(0)), F.col(group), *order, name=name).withColumn(salt, F.pmod(F.col(name), F.lit(SALTS)).cast("int"))
    firsts = placed.groupBy(F.col(group).alias(key)).agg(F.min(name).alias(first)).withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    got = placed.join(firsts, placed[group].eqNullSafe(firsts[key]) & (placed[salt] == firsts[f"{salt}_"]))
    return got.withColumn(name, (F.col(name) - F.col(first) + 1).cast("int")).drop(key, first, salt, f"{salt}_")
