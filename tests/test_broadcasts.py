"""Tables that grow don't pass through the driver to be broadcast, while they are small enough for Spark to try."""

from pyspark.sql import functions as F

from strandline.operators import embed, graph


def test_growing_joins_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.array(F.col("id") * 1.0).alias("x"))
    one = spark.range(50).withColumn("v", F.lit(1))
    for joined in (graph.spread(rows, one, "id", "id"), graph.matched(rows, one, "id", "left")):
        joined.collect()
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_single_linkage_are_not_broadcast(spark, monkeypatch):
    """Of all tables that are written on the way."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rows = spark.range(60).select("id", F.array((F.col("id") * F.col("id") % 61) * 1.0, F.col("id") * 0.5).alias("x"))
    assert embed.merge_heights(rows).count() == 59
    # The offsets of positions have a row a partition.
    assert plans and not any("BroadcastHashJoin" in p for p in plans if "__before" not in p)
