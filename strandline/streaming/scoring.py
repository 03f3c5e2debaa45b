"""Scoring a stream with fitted parameters: an extension, stateless, with the same code as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..operators.mixture import Params, e_step


def scored_stream(stream: DataFrame, params: Params) -> DataFrame:
    """stream with gamma and k (most likely component) for its array column x."""
    return e_step(stream, params).withColumn("k", argmax(F.col("gamma")))


def windowed_counts(scored: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Rows of each component in windows of event time; rows later than ``late`` are dropped."""
    return scored.withWatermark(time, late).groupBy(F.window(time, width), "k").agg(F.count("*").alias("n"))
