"""Graphs as edge tables: joins that spread hot keys, connected components, sums along the way to a root. One written table a round, so no plan grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import discard, materialise

#: Parts over which the rows of one key are spread before a join with the key's one row.
SALTS = 16


def matched(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow: by sorting both sides. While one is small enough to be broadcast it would pass through the driver, round after round."""
    return rows.join(other.hint("merge"), on, how)


def spread(rows: DataFrame, one: DataFrame, key: str | list[str], by: str | list[str], how: str = "inner") -> DataFrame:
    """rows with the one row of their key. Rows of a key are dealt over salts first, so that a hot key isn't one task."""
    keys, by = ([x] if isinstance(x, str) else x for x in (key, by))
    salted = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return matched(rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")), salted, [*keys, "salt"], how).drop("salt")


def components(spark: SparkSession, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, root (the smallest node) for every node of the edges a, b, by alternating large and small stars (Kiveris et al. 2014).

    Goes on until it is done; if that takes more than ``most`` rounds, when given, it raises an error.
    """
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds = 0
    while True:
        rounds += 1
        if most is not None and rounds > most:
            raise RuntimeError(f"components aren't done after {most} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = spread(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread(large, down, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(down.select("a", F.col("m").alias("b")))
        new = materialise(small.distinct(), "edges")
        # Done when every node has one edge and no root has any.
        nodes = new.groupBy("a").agg(F.count("*").alias("n"))
        again = nodes.where("n > 1").limit(1).count() or matched(new, new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        discard(edges)
        edges = new
        if not again:
            break
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def climbed(links: DataFrame) -> DataFrame:
    """node, up, off: the root of each node, and the sum of ``off`` on the way there, by pointer jumping.

    ``links`` has the same columns: each node's next one and what the step adds; a root is its own next one and adds nothing. The number of
    rounds is the logarithm of the longest way.
    """
    links = materialise(links, "links")
    while True:
        nexts = links.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("off").alias("more"))
        new = materialise(spread(links, nexts, "up", "node").select("node", F.col("next").alias("up"), (F.col("off") + F.col("more")).alias("off"), (F.col("up") != F.col("next")).alias("moved")), "links")
        discard(links)
        links = new.select("node", "up", "off")
        if not new.where("moved").limit(1).count():
            return links
