"""Simple random samples without replacement, by a hash of the id: the same rows for the same seed, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import spare


def draw(seed: int, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sample_rows(df: DataFrame, n: int, seed: int = 1, id_col: str = "id") -> DataFrame:
    """At most n rows, those with the smallest hashes (null ids first). A threshold on the hash first leaves few more than n, so no task takes n rows from every other."""
    hashed = draw(seed, id_col)
    first = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / 2.0**32
    share = (n + 6 * math.sqrt(n) + 20) / max(1, df.count())
    while share < 1:
        near = df.where(first.isNull() | (first < share))
        if near.count() >= n:
            return near.orderBy(hashed, id_col).limit(n)
        share *= 2
    return df.orderBy(hashed, id_col).limit(n)


def sample_strata(df: DataFrame, group: str, n: int, seed: int = 1, id_col: str = "id") -> DataFrame:
    """At most n rows of each group. Spark limits each group inside the tasks before it shuffles."""
    w = Window.partitionBy(group).orderBy(draw(seed, id_col), id_col)
    rank = spare(df, "__rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)
