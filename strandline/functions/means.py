"""Means that don't depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(name: str) -> Column:
    """The mean of a column of doubles by an exact sum, so equal values have equal means however tasks cut the rows.

    Values are summed as decimals. Where one isn't a decimal of 18 places below 10^9, the mean is the plain one.
    """
    v = F.col(name)
    exact = F.when(F.abs(v) < 1e9, v.cast("decimal(38,18)"))
    fits = F.coalesce(F.bool_and(F.coalesce(exact.cast("double") == v, v.isNull())), F.lit(True))
    return F.when(fits, F.sum(exact).cast("double") / F.nullif(F.count(v), F.lit(0))).otherwise(F.avg(v))
