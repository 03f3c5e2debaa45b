"""Plot-ready tables; drawing them is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import materialise
from .graph import spread
from .mixture import Params
from .ordering import positions
from .sampling import draw


def _long(rows: DataFrame, keys: list[str], prefix: str, name: str, value: str, which: list[int] | None) -> DataFrame:
    out = rows.select(*keys, F.posexplode("x").alias("__j", value))
    if which is not None:
        out = out.where((F.col("__j") + 1).isin([int(j) for j in which]))
    return out.select(*keys, F.concat(F.lit(prefix), (F.col("__j") + 1).cast("string")).alias(name), value)


def structure_by_order(data: DataFrame, order: DataFrame, which: list[int] | None = None) -> DataFrame:
    """x, Component, Value: rows along an order (id, position), one for each column."""
    rows = data.select("id", "x").join(order.select("id", "position"), "id").select(F.col("position").cast("bigint").alias("at"), "x")
    return _long(rows, ["at"], "loading", "Component", "Value", which).withColumnRenamed("at", "x")


def structure_by_group(data: DataFrame, order: DataFrame, which: list[int] | None = None) -> DataFrame:
    """x, Group, Component, Value: groups in the order of their smallest id, x running on over all.

    order has (id, group, position) with positions inside groups.
    """
    firsts = order.groupBy("group").agg(F.min("id").alias("first_id"))
    # Positions over (the group's least id, position) run on from group to group: no window over all groups stands in one task.
    placed = positions(spread(order.select("id", "group", "position"), firsts, "group", "id"), F.col("first_id"), F.col("group"), F.col("position"), name="at")
    rows = data.select("id", "x").join(placed.select("id", "group", "at"), "id").select("at", F.col("group").alias("Group"), "x")
    return _long(rows, ["at", "Group"], "loading", "Component", "Value", which).withColumnRenamed("at", "x")


def structure_by_id(data: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Sample, Factor, Loading, and with an order the sample's position in it (null if it isn't there)."""
    rows, keys = data.select(F.col("id").alias("Sample"), "x"), ["Sample"]
    if order is not None:
        if order.join(data.select("id"), "id", "left_anti").limit(1).count():
            raise ValueError("the order holds an id that the data don't")
        rows = rows.join(order.select(F.col("id").alias("Sample"), "position"), "Sample", "left")
        keys = ["Sample", "position"]
    return _long(rows, keys, "Factor", "Factor", "Loading", None)


def _with_metric(types: DataFrame, metric: DataFrame | None, order: DataFrame | None) -> DataFrame:
    """Sample, Metric, Type from types (id, type), and either (id, metric) or (id, position)."""
    if metric is not None:
        rows = metric.select("id", F.col("metric").cast("double").alias("Metric"))
    elif order is not None:
        if order.join(types.select("id"), "id", "left_anti").limit(1).count():
            raise ValueError("the order holds an id without a type")
        n = order.count()
        rows = order.select("id", (F.col("position") / F.lit(n)).alias("Metric"))
    else:
        raise ValueError("a metric or an order is needed")
    return rows.join(types.select("id", F.col("type").alias("Type")), "id").withColumnRenamed("id", "Sample")


def highlighted_types(types: DataFrame, subset: list[str], metric: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """Sample, Metric, Type, Highlight (the type, or Other), width of a bar."""
    rows = _with_metric(types, metric, order)
    s = rows.agg(F.count("*").alias("n"), (F.max("Metric") - F.min("Metric")).alias("range")).first()
    width = ((s["range"] if metric is not None else 1.0) or 0.0) / max(1, s["n"])
    return rows.withColumn("Highlight", F.when(F.col("Type").isin(subset), F.col("Type")).otherwise("Other")).withColumn("width", F.lit(float(width)))


def quantiles(rows: DataFrame, group: str, value: str, at: list[float], bins: int = 256) -> dict:
    """group -> the exact quantiles ``at`` (interpolated between the two nearest ranks) of its values, for a bounded number of groups; nulls and NaN count as absent.

    Each rank that is wanted lies between two of the group's values. A round cuts that range into bins and counts; the next range is that of the values in the
    bin that holds the rank. So a round sends ``bins`` numbers a rank, whatever the number of rows, and no task holds a group's values.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    spark, kind = rows.sparkSession, rows.schema["g"].dataType.simpleString()
    sizes = {r["g"]: (r["n"], r["low"], r["high"]) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    place = lambda g, p: p * (sizes[g][0] - 1)
    wanted = {(g, min(int(place(g, p)) + up, sizes[g][0] - 1)) for g in sizes for p in at for up in (0, 1)}
    found, open_ = {}, {(g, rank): (sizes[g][1], sizes[g][2], 0) for g, rank in wanted}  # the range, and how many values lie below it
    while True:
        found |= {key: low for key, (low, high, _) in open_.items() if low == high}
        open_ = {key: v for key, v in open_.items() if v[0] < v[1]}
        if not open_:
            break
        ranges = spark.createDataFrame([(g, rank, low, high) for (g, rank), (low, high, _) in open_.items()], f"g {kind}, rank bigint, low double, high double")
        inside = rows.join(F.broadcast(ranges), "g").where("v between low and high")
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins)).cast("int")
        counts: dict = {}
        for r in inside.groupBy("g", "rank", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            counts.setdefault((r["g"], r["rank"]), []).append((r["bin"], r["n"], r["low"], r["high"]))
        for key, parts in counts.items():
            below = open_[key][2]
            for _, n, low, high in sorted(parts):
                if key[1] < below + n:
                    open_[key] = (low, high, below)
                    break
                below += n

    def between(g, p: float) -> float:
        k = int(place(g, p))
        a, b = found[g, k], found[g, min(k + 1, sizes[g][0] - 1)]
        return a + (place(g, p) - k) * (b - a)

    return {g: [between(g, p) for p in at] for g in sizes}


def with_quantiles(summary: DataFrame, rows: DataFrame, at: dict[str, float]) -> DataFrame:
    """summary (by Type) with the quantiles of Metric under the given names."""
    found = quantiles(rows, "Type", "Metric", list(at.values()))
    kind = rows.schema["Type"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(g, *map(float, q)) for g, q in found.items()], f"Type {kind}, " + ", ".join(f"{n} double" for n in at))
    return summary.join(F.broadcast(table), "Type", "left")  # a row for each chosen type


def type_summary(types: DataFrame, subset: list[str], metric: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """Type, n, mean, sd, least, q1, median, q3, most of the metric of each chosen type. Quantiles are exact."""
    rows = _with_metric(types, metric, order).where(F.col("Type").isin(subset))
    whole = rows.groupBy("Type").agg(F.count("*").alias("n"), F.avg("Metric").alias("mean"), F.stddev_samp("Metric").alias("sd"), F.min("Metric").alias("least"), F.max("Metric").alias("most"))
    return with_quantiles(whole, rows, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select("Type", "n", "mean", "sd", "least", "q1", "median", "q3", "most")


def bandwidths(rows: DataFrame) -> DataFrame:
    """Type, n, least, most, h: Silverman's bandwidth of the metric of each type, from the smaller of its two measures of width."""
    own = rows.groupBy("Type").agg(F.count("*").alias("n"), F.min("Metric").alias("least"), F.max("Metric").alias("most"), F.stddev_samp("Metric").alias("sd"))
    own = with_quantiles(own, rows, {"q1": 0.25, "q3": 0.75}).withColumn("iqr", (F.col("q3") - F.col("q1")) / 1.34)
    narrow = F.when((F.col("iqr") > 0) & (F.col("iqr") < F.col("sd")), F.col("iqr")).otherwise(F.col("sd"))
    return own.select("Type", "n", "least", "most", (0.9 * narrow * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))


def kernel(at: Column, value: Column, h: Column) -> Column:
    return F.exp(-0.5 * F.pow((at - value) / h, 2)) / (h * math.sqrt(2 * math.pi))


def type_violin(types: DataFrame, subset: list[str], metric: DataFrame | None = None, order: DataFrame | None = None, points: int = 512, reach: float = 3.0) -> DataFrame:
    """Type, i, at, density, width: the outline of a violin for each chosen type, untrimmed.

    Each type has its own grid, from ``reach`` bandwidths below its least value to as many above its largest. width is the density over the largest one of all types
    (so areas can be compared). A type of one row, or of equal values, has no density and isn't given.
    """
    rows = _with_metric(types, metric, order).where(F.col("Type").isin(subset))
    own = bandwidths(rows).where("h > 0")
    step = (F.col("most") - F.col("least") + 2 * reach * F.col("h")) / max(1, points - 1)
    rows = rows.join(F.broadcast(own), "Type").select("Type", "Metric", "n", "h", F.posexplode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i", "g"), (F.col("least") - reach * F.col("h")).alias("from"), step.alias("step"))
    rows = rows.withColumn("at", F.col("from") + F.col("i") * F.col("step"))
    out = rows.groupBy("Type", "i", "at", "n").agg((F.sum(kernel(F.col("at"), F.col("Metric"), F.col("h"))) / F.col("n")).alias("density")).select("Type", "i", "at", "density")
    out = materialise(out, "violin")  # a row for each chosen type and point
    largest = out.agg(F.max("density")).first()[0]
    return out.withColumn("width", F.col("density") / F.lit(largest))


def type_points(types: DataFrame, subset: list[str], metric: DataFrame | None = None, order: DataFrame | None = None, width: float = 0.1, seed: int = 1) -> DataFrame:
    """Sample, Metric, Type, offset: the points over the violins, each moved aside by up to ``width`` by a hash of the seed and the sample."""
    rows = _with_metric(types, metric, order).where(F.col("Type").isin(subset))
    first = F.conv(F.substring(draw(seed, "Sample"), 1, 8), 16, 10).cast("double") / 2.0**32
    return rows.withColumn("offset", (2 * first - 1) * width)


def type_density(types: DataFrame, subset: list[str], metric: DataFrame | None = None, order: DataFrame | None = None, points: int = 64, bandwidth: float | None = None, span: tuple[float, float] | None = None) -> DataFrame:
    """Type, at, density: Gaussian kernel density of each chosen type on a grid; by default of Silverman's bandwidth by type.

    Every row meets the grid inside its task, as an array of kernel values that is summed by type and grid point.
    """
    rows = _with_metric(types, metric, order).where(F.col("Type").isin(subset))
    if span is None:
        s = rows.agg(F.min("Metric"), F.max("Metric")).first()
        span = (s[0] or 0.0, s[1] or 0.0)
    grid = [span[0] + (span[1] - span[0]) * i / max(1, points - 1) for i in range(points)]
    own = rows.groupBy("Type").agg(F.count("*").alias("n"), F.lit(float(bandwidth)).alias("h")) if bandwidth else bandwidths(rows)
    rows = rows.join(F.broadcast(own.select("Type", F.col("n").alias("total"), "h")), "Type")  # a row for each chosen type
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("at")) for i, g in enumerate(grid)])).alias("g")
    height = kernel(F.col("g.at"), F.col("Metric"), F.col("h"))
    return rows.select("Type", "Metric", "total", "h", at).groupBy("Type", "g.i", "g.at", "total").agg((F.sum(height) / F.col("total")).alias("density")).select("Type", "at", "density")


def path_segments(params: Params, spark, least: float = 1e-6) -> DataFrame:
    """k, from, to: the steps between the means of consecutive components, without those that are as short as ``least``."""
    rows = params.as_frame(spark).select("k", "mu")
    step = rows.withColumn("next", F.lead("mu").over(Window.orderBy("k"))).where(F.col("next").isNotNull())
    length = F.sqrt(F.aggregate(F.zip_with("mu", "next", lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda a, v: a + v))
    return step.where(length > least).select("k", F.col("mu").alias("from"), F.col("next").alias("to"))


def mean_curves(params: Params, spark, locations: list[float] | None = None) -> DataFrame:
    """location, dimension, mean: each dimension of the means over the components' locations (0..1 by default)."""
    k = len(params.pi)
    at = locations if locations is not None else [i / max(1, k - 1) for i in range(k)]
    where = F.array(*[F.lit(float(t)) for t in at])
    return params.as_frame(spark).select(F.element_at(where, F.col("k")).alias("location"), F.posexplode("mu").alias("j", "mean")).select("location", (F.col("j") + 1).alias("dimension"), "mean")
