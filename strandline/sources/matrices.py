"""Observation matrices as DataFrames (id, x ARRAY<DOUBLE>): reading, checking, wide form and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def validated(df: DataFrame, id_col: str = "id", x_col: str = "x") -> DataFrame:
    """df, if every x has the same length, no null, NaN or infinite entry, and ids are unique and not null; else ValueError.

    One aggregation over the data, and one count by id that stops at the first repeat.
    """
    fine = F.forall(x_col, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    r = df.agg(
        F.count("*").alias("n"), F.min(F.size(x_col)).alias("least"), F.max(F.size(x_col)).alias("most"),
        F.sum(F.when(fine, 0).otherwise(1)).alias("bad"), F.count(id_col).alias("ids"),
    ).first()
    if r["n"]:
        if r["bad"]:
            raise ValueError(f"{r['bad']} rows hold a null, NaN or infinite feature")
        if r["least"] != r["most"] or r["least"] < 1:
            raise ValueError(f"rows have between {r['least']} and {r['most']} features")
        if r["ids"] < r["n"]:
            raise ValueError("an id is null")
        if df.groupBy(id_col).count().where("count > 1").limit(1).count():
            raise ValueError("an id occurs twice")
    return df


def from_wide(df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))


def to_wide(df: DataFrame, d: int, prefix: str = "f") -> DataFrame:
    return df.select(*[c for c in df.columns if c != "x"], *[F.col("x")[j].alias(f"{prefix}{j + 1}") for j in range(d)])


def columns_of(x: Column | str, indices: list[int]) -> Column:
    """The entries at 1-based positions."""
    x = F.col(x) if isinstance(x, str) else x
    return F.array(*[F.element_at(x, int(i)) for i in indices])


def energy_features(spark: SparkSession, sf_dir: str, blocks: int = 8, size: int = 8) -> DataFrame:
    """id, x, grp from embeddings: x_j is the sum of squares of the j-th block of ``size`` entries."""
    part = lambda j: F.aggregate(F.slice("v", j * size + 1, size), F.lit(0.0), lambda a, e: a + e * e)
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("grp"))
    return rows.select("id", F.array(*[part(j) for j in range(blocks)]).alias("x"), "grp")


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x of four scaled measures of each line item; there is no unique id."""
    x = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10).cast("array<double>")
    return read_table(spark, sf_dir, "lineitem").select(x.alias("x"))
