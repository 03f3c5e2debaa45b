"""Length of the path through rows in a given order, as windows and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import Distance, euclidean, normalised

#: Consecutive positions that one window task takes.
STRETCH = 100_000


def _steps(data: DataFrame, order: DataFrame, keys: list[str], distance: Distance, normalise: bool) -> DataFrame:
    """keys and distance from the position before, for every row; null at the first.

    Positions are cut into stretches, and each stretch also gets the row before it, so a group of any size is spread.
    """
    rows = data.select("id", "x").join(order.select("id", "position", *keys), "id")
    one = F.size("x") == 1
    x = F.when(one, F.array(F.lit(0.0))).otherwise(normalised(F.col("x"))) if normalise else F.col("x")
    rows = rows.select(*keys, "position", x.alias("x"))
    home = F.floor((F.col("position") - 1) / STRETCH)
    edge = F.when(F.col("position") % STRETCH == 0, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("home", home).withColumn("stretch", F.explode(edge))
    w = Window.partitionBy(*keys, "stretch").orderBy("position")
    return rows.withColumn("step", distance(F.col("x"), F.lag("x").over(w))).where(F.col("home") == F.col("stretch"))


def _checked(data: DataFrame, order: DataFrame) -> None:
    if data.count() != order.count():
        raise ValueError("the order must hold every row once")


def path_loss(data: DataFrame, order: DataFrame, distance: Distance = euclidean, normalise: bool = False, check: bool = True) -> DataFrame:
    """loss: sum of the distances of rows (id, x) next to each other in order (id, position).

    ``normalise`` divides rows by their sums first, which is 0 for a single column and an error for a sum of zero.
    ``distance`` takes two array columns.
    """
    if check:
        _checked(data, order)
    return _steps(data, order, [], distance, normalise).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("loss"))


def group_losses(data: DataFrame, order: DataFrame, distance: Distance = euclidean, normalise: bool = False) -> DataFrame:
    """group, n, loss for order (id, group, position) with positions inside groups."""
    steps = _steps(data, order, ["group"], distance, normalise)
    return steps.groupBy("group").agg(F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("loss"))


def grouped_loss(data: DataFrame, order: DataFrame, distance: Distance = euclidean, normalise: bool = False, weighted: bool = False, check: bool = True) -> DataFrame:
    """loss: mean of the group losses, or their mean weighted by the groups' sizes."""
    if check:
        _checked(data, order)
    value = F.sum(F.col("loss") * F.col("n")) / F.sum("n") if weighted else F.avg("loss")
    return group_losses(data, order, distance, normalise).agg(value.alias("loss"))
