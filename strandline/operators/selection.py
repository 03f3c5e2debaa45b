"""Greedy forward selection of columns by the length of the tour they give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.matrices import columns_of
from .routes import route
from .sampling import sample_rows, sample_strata
from .tours import method_named, path_length

SAMPLE = 3_000


def candidate_losses(data: DataFrame, candidates: list[list[int]], method: str, normalise: bool, weighted: bool) -> DataFrame:
    """candidate (number in the list), loss. A tour for each candidate and group, side by side; then one row a candidate."""
    rows = data.select("group", "id", "x")
    table = F.array(*[F.struct(F.lit(c).alias("candidate"), columns_of("x", cols).alias("y")) for c, cols in enumerate(candidates)])
    rows = rows.withColumn("c", F.explode(table)).select("group", "id", "c.candidate", "c.y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id", kind="stable")["y"])
        return pd.DataFrame({"candidate": [pdf["candidate"].iloc[0]], "n": [len(x)], "loss": [path_length(x, route(x, method), normalise)]})

    # Given as a number: tours take time, not bytes, and Spark would join small partitions into one task.
    tasks = max(16 * len(candidates), int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_group = rows.repartition(tasks, "candidate", "group").groupBy("candidate", "group").applyInPandas(run, "candidate int, n bigint, loss double")
    value = F.sum(F.col("loss") * F.col("n")) / F.sum("n") if weighted else F.avg("loss")
    return by_group.groupBy("candidate").agg(value.alias("loss"))


def _select(data: DataFrame, start: int, method: str, normalise: bool, weighted: bool) -> DataFrame:
    method_named(method)
    spark, first = data.sparkSession, data.select("x").first()
    if first is None:
        raise ValueError("there are no rows")
    d = len(first["x"])
    if not 1 <= start <= d:
        raise ValueError(f"start must be a column from 1 to {d}")
    held = data.persist()
    try:
        chosen, out = [], []
        while len(chosen) < d:
            rest = [j for j in range(1, d + 1) if j not in chosen] if chosen else [start]
            losses = {r["candidate"]: r["loss"] for r in candidate_losses(held, [chosen + [j] for j in rest], method, normalise, weighted).collect()}
            best = min(range(len(rest)), key=lambda c: (losses[c], c))  # of equals the earliest column
            chosen.append(rest[best])
            out.append((len(chosen), rest[best], float(losses[best])))
    finally:
        held.unpersist()
    return spark.createDataFrame(out, "step int, factor int, loss double")


def forward_selection(data: DataFrame, start: int = 1, normalise: bool = False, method: str = "farthest_insertion", fast: bool = False, seed: int = 1) -> DataFrame:
    """step, factor, loss: from column ``start``, each step adds the column that gives the shortest tour. ``fast`` samples 3000 rows."""
    rows = sample_rows(data, SAMPLE, seed) if fast else data
    return _select(rows.select(F.lit("all").alias("group"), "id", "x"), start, method, normalise, False)


def grouped_forward_selection(data: DataFrame, group: str, start: int = 1, normalise: bool = False, method: str = "nn", weighted: bool = False, fast: bool = False, fast_rows: int = SAMPLE, seed: int = 1) -> DataFrame:
    """The same with tours inside groups and the mean (or size-weighted mean) of their lengths. ``fast`` samples each group."""
    rows = sample_strata(data, group, fast_rows, seed) if fast else data
    return _select(rows.select(F.col(group).cast("string").alias("group"), "id", "x"), start, method, normalise, weighted)


def elbow_table(selection: DataFrame) -> DataFrame:
    """step, loss, label for an elbow plot."""
    return selection.select("step", "loss", F.col("factor").cast("string").alias("label"))
