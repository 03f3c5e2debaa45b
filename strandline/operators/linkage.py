"""Dendrograms of any number of rows: single linkage by a minimum spanning tree, Ward's by reciprocal nearest clusters.

*Single linkage.* Borůvka's rounds: every component takes the shortest edge that leaves it, and components along these edges become one. Lists of
nearest rows answer most of it; only rows whose list ends inside their own component, nearer than the component's best edge, search
again, in the cells that the best edge can reach. Edges in order of length are the merges.

Who merges with whom at what time takes all shorter edges to be known. Edges are cut in half by rank, again and again: rows that the lower
half connects become one row in the upper half, at the same time in every piece, until a piece has ``BLOCK`` edges at most. Pieces are then
merged on their own, in a task each.

*Ward.* Clusters that are nearest to each other merge, all such pairs in one round: no other merge can come between them (the linkage is
reducible). Only clusters that are new, or whose nearest has gone, search again. Centroids and sizes are a written table. The
last ``LAST`` clusters are merged in one task.

Both give rows (step, height, left, right, left_size, right_size): a cluster goes by its least row, and ``left`` is the lesser. The one on the
right never leads a cluster again, so merges are links from each row to another, and a leaf's place is the sum of the sizes to its left along
these links, by pointer jumping. Equal heights: by the ids of the edge (single), by the clusters' least rows (Ward). Equal rows merge first, at height 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, materialise
from . import cells as pivots
from .graph import climbed, components, matched, spread
from .mixture import rows_of
from .ordering import positions

#: Edges that one task merges; clusters that one task ends with; neighbours in the lists.
BLOCK, LAST, LIST = 1 << 16, 2048, 8
MERGE = "height double, left {0}, right {0}, left_size bigint, right_size bigint"


def distinct_rows(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, x, n of rows that differ, each by its least id with the number of its copies; and the copies: left, right, left_size (rows before it)."""
    rows = data.select("id", "x").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rows = materialise(rows.select("id", "x", "n"), "distinct")
    hot = rows.where("n > 1")
    if not hot.limit(1).count():
        return rows, data.sparkSession.createDataFrame([], f"left {data.schema['id'].dataType.simpleString()}, right {data.schema['id'].dataType.simpleString()}, left_size bigint")
    # Copies by id, without a sort of all copies of one row in a task: places over (row, id) less the row's first place.
    copies = spread(data.select("id", "x"), hot.select("x", F.col("id").alias("left")), "x", "id").select("left", "id")
    placed = positions(copies, F.col("left"), F.col("id"))
    firsts = placed.groupBy("left").agg(F.min("position").alias("first"))
    placed = spread(placed, firsts, "left", "id").where("id != left")
    return rows, placed.select("left", F.col("id").alias("right"), (F.col("position") - F.col("first")).alias("left_size"))


def spanning_tree(nodes: DataFrame, k: int = LIST, **options) -> DataFrame:
    """a, b, distance (a < b): the minimum spanning tree of rows that differ; of equal lengths, edges with smaller ids."""
    spark, kind = nodes.sparkSession, nodes.schema["id"].dataType.simpleString()
    cells = pivots.deal(nodes.select("id", "x"), **options)
    lists = materialise(pivots.nearest(cells, k), "lists")
    ends = lists.groupBy("id").agg(F.max("distance").alias("end"), F.count("*").alias("n"))
    points = materialise(matched(cells.rows, ends, "id", "left").withColumn("end", F.when(F.col("n") >= k, F.col("end")).otherwise(F.lit(float("inf")))).drop("n"), "points")
    labels = materialise(nodes.select("id", F.col("id").alias("label")), "labels")
    tree = spark.createDataFrame([], f"a {kind}, b {kind}, distance double")
    key = F.struct("distance", F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "other").alias("e")
    while True:
        other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
        lists = materialise(matched(matched(lists.select("id", "neighbour", "distance"), labels, "id"), other, "neighbour").where("label != other"), "lists")
        best = materialise(lists.groupBy("label").agg(F.min(key).alias("e")), "best")
        labelled = materialise(matched(points, labels, "id"), "labelled")
        pure = {r["cell"]: (r["a"], r["b"]) for r in labelled.groupBy("cell").agg(F.min("label").alias("a"), F.max("label").alias("b")).collect()}
        if len({v for pair in pure.values() for v in pair}) < 2:
            return tree
        found = leaving(cells, labelled, lists, best, pure)
        edges = lists.select("label", key).unionByName(found.select("label", key)).groupBy("label").agg(F.min("e").alias("e"))
        edges = materialise(edges.select("label", "e.*"), "chosen")
        tree = materialise(tree.unionByName(edges.select("a", "b", "distance").distinct()), "tree")
        # Of two components that chose each other the lesser is the root.
        back = edges.select(F.col("label").alias("other"), F.col("other").alias("back"))
        links = spread(edges.select("label", "other"), back, "other", "label")
        up = F.when((F.col("back") == F.col("label")) & (F.col("label") < F.col("other")), F.col("label")).otherwise(F.col("other"))
        roots = climbed(links.select(F.col("label").alias("node"), up.alias("up"), F.lit(0).cast("bigint").alias("off")))
        new = materialise(spread(labels, roots.select(F.col("node").alias("label"), F.col("up").alias("root")), "label", "id").select("id", F.col("root").alias("label")), "labels")
        for gone in (labelled, labels, best, edges, roots):
            discard(gone)
        labels = new


def leaving(cells: pivots.Cells, labelled: DataFrame, lists: DataFrame, best: DataFrame, pure: dict) -> DataFrame:
    """id, neighbour, distance, label, other of the nearest rows outside their component, for rows whose list doesn't say and that may have the component's shortest edge."""
    m = len(cells.pivots)
    low_label, high_label = (np.array([pure[c][i] if c in pure else None for c in range(m)], object) for i in (0, 1))
    some = np.array([c in pure for c in range(m)])
    bound = best.select("label", F.col("e.distance").alias("bound"))
    rows = spread(matched(labelled, lists.select("id").distinct(), "id", "left_anti"), bound, "label", "id", "left").where("bound is null or end <= bound")

    def foreign(t: pa.Table) -> np.ndarray:
        label = t["label"].to_numpy(zero_copy_only=False)[:, None]
        return some & ((low_label != label) | (high_label != label))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pivots.pieces(batches):
            t = pa.Table.from_batches([p])
            u = np.where(foreign(t), cells.bounds(rows_of(p))[1] + cells.reach, np.inf).min(axis=1, initial=np.inf)
            yield pa.RecordBatch.from_arrays([p["label"], pa.array(u)], ["label", "u"])

    # A component without any edge in the lists: no row of it is farther from another component than a cell that holds one.
    kind = labelled.schema["label"].dataType.simpleString()
    lost = rows.where("bound is null").select("x", "label").mapInArrow(far, f"label {kind}, u double").groupBy("label").agg(F.min("u").alias("far"))
    rows = materialise(spread(rows, lost, "label", "id", "left").withColumn("bound", F.coalesce("bound", "far")).where("end <= bound").drop("far"), "leaving")

    def reaches(t: pa.Table, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        u = t["bound"].to_numpy()
        yield np.arange(len(x)), u, cells.within(low, high, u) & foreign(t)

    asked = pivots.asking(cells, rows, reaches, False, ["id", "x", "label"])
    found = pivots.search(cells, labelled, asked, 1, label="label").withColumnRenamed("label", "other")
    return matched(pivots.best_of(found, 1).drop("rank"), rows.select("id", "label"), "id")


class Merging:
    """Clusters of one task: the least row leads, sizes add up."""

    def __init__(self, sizes: dict):
        self.up, self.size, self.rows = {v: v for v in sizes}, dict(sizes), []

    def root(self, v):
        up = self.up
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def add(self, a, b, height: float) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.rows.append((height, a, b, self.size[a], self.size[b]))
        self.up[b] = a
        self.size[a] += self.size[b]


def tree_merges(tree: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """height, left, right, left_size, right_size of the merges along the edges of a tree, from the least; ``sizes`` has id, n of each row."""
    spark, kind = tree.sparkSession, sizes.schema["id"].dataType.simpleString()
    edges = materialise(positions(tree, F.col("distance"), F.col("a"), F.col("b"), name="rank"), "ranked")
    n, size = edges.count(), block
    while size < n:
        size *= 2
    piece = lambda of: F.expr(f"(rank - 1) div {of}").cast("bigint").alias("s")
    nodes = materialise(sizes.select(F.lit(0).cast("bigint").alias("s"), F.col("id").alias("v"), "n"), "nodes")
    while size > block:
        half = size // 2
        lower = F.expr(f"(rank - 1) % {size} < {half}")
        one = lambda c: F.struct(piece(size), F.col(c).alias("v"))
        joined = components(spark, edges.where(lower).select(one("a").alias("a"), one("b").alias("b")))
        roots = materialise(joined.select(F.col("node.s").alias("s"), F.col("node.v").alias("v"), F.col("root.v").alias("root")), "roots")
        upper = edges.where(~lower).withColumn("s", piece(size))
        for c in ("a", "b"):
            upper = spread(upper, roots.withColumnRenamed("v", c), ["s", c], "rank", "left").withColumn(c, F.coalesce("root", c)).drop("root")
        edges = materialise(edges.where(lower).select("rank", "a", "b", "distance").unionByName(upper.select("rank", "a", "b", "distance")), "ranked")
        below = nodes.select((F.col("s") * 2).alias("s"), "v", "n")
        above = matched(nodes, roots, ["s", "v"], "left").groupBy((F.col("s") * 2 + 1).alias("s"), F.coalesce("root", "v").alias("v")).agg(F.sum("n").alias("n"))
        ends = edges.select(piece(half), F.explode(F.array("a", "b")).alias("v")).distinct()
        nodes = materialise(matched(below.unionByName(above), ends, ["s", "v"], "left_semi"), "nodes")
        size = half

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        work = Merging(dict(zip(right["v"].to_pylist(), right["n"].to_pylist())))
        t = left.sort_by("rank")
        for a, b, d in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["distance"].to_pylist()):
            work.add(a, b, d)
        names = ["height", "left", "right", "left_size", "right_size"]
        cols = list(zip(*work.rows)) or [[]] * 5
        kinds = [pa.float64(), right["v"].type, right["v"].type, pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    by = edges.withColumn("s", piece(size)).groupBy("s").cogroup(nodes.groupBy("s"))
    return by.applyInArrow(merge, MERGE.format(kind))


def single(data: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The merges of single linkage."""
    rows, copies = distinct_rows(data)
    merges = tree_merges(spanning_tree(rows, **options), rows, block)
    return numbered(merges, copies)


def ward(data: DataFrame, last: int = LAST, **options) -> DataFrame:
    """The merges of Ward's linkage on Euclidean distances (D2, Murtagh & Legendre 2014)."""
    spark, kind = data.sparkSession, data.schema["id"].dataType.simpleString()
    rows, copies = distinct_rows(data)
    clusters = rows.withColumn("near", F.lit(None).cast(kind)).withColumn("distance", F.lit(None).cast("double"))
    done = []
    while clusters.limit(last + 1).count() > last:
        cells = pivots.deal(clusters, size="n", **options)
        found = pivots.best_of(pivots.search(cells, cells.rows, ward_asked(cells), 1, size="n"), 1)
        found = found.select("id", F.col("neighbour").alias("new"), F.col("distance").alias("new_distance"))
        now = matched(cells.rows, found, "id", "left").select("id", "x", "n", F.coalesce("near", "new").alias("near"), F.coalesce("distance", "new_distance").alias("distance"))
        now = materialise(now, "nearest")
        pair = now.select(F.col("id").alias("near"), F.col("near").alias("back"), F.col("x").alias("y"), F.col("n").alias("m"))
        pairs = materialise(matched(now, pair, "near").where("back = id and id < near"), "pairs")
        done.append(pairs.select(F.col("distance").alias("height"), F.col("id").alias("left"), F.col("near").alias("right"), F.col("n").alias("left_size"), F.col("m").alias("right_size")))
        gone = pairs.select(F.explode(F.array("id", "near")).alias("gone"))
        left = matched(now, gone, now["id"] == gone["gone"], "left_anti")
        # One that has lost its nearest searches again.
        left = spread(left, gone.select(F.col("gone").alias("near"), F.lit(True).alias("lost")), "near", "id", "left")
        stay = F.col("lost").isNull()
        left = left.select("id", "x", "n", F.when(stay, F.col("near")).alias("near"), F.when(stay, F.col("distance")).alias("distance"))
        centre = F.zip_with("x", "y", lambda a, b: (a * F.col("n") + b * F.col("m")) / (F.col("n") + F.col("m")))
        new = pairs.select("id", centre.alias("x"), (F.col("n") + F.col("m")).alias("n"), F.lit(None).cast(kind).alias("near"), F.lit(None).cast("double").alias("distance"))
        clusters = materialise(left.unionByName(new), "clusters")
        for old in (cells.rows, now):
            discard(old)

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, n = t["id"].to_pylist(), t["n"].to_pylist()
        work = Merging(dict(zip(ids, n)))
        for a, b, h in ward_merges(rows_of(t["x"].combine_chunks()), np.array(n, float)):
            work.add(ids[a], ids[b], h)
        cols, kinds = list(zip(*work.rows)) or [[]] * 5, [pa.float64(), t["id"].type, t["id"].type, pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["height", "left", "right", "left_size", "right_size"])

    rest = clusters.select("id", "x", "n", F.lit(0).alias("all")).groupBy("all").applyInArrow(finish, MERGE.format(kind))  # ``last`` clusters at most
    # A table for each round, each with its own merges: their number goes with the logarithm of the rows.
    return numbered(reduce(DataFrame.unionByName, done, rest), copies)


def ward_asked(cells: pivots.Cells) -> DataFrame:
    """Clusters without a nearest one, and the parts in which it may be."""

    def weighted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(2 * a[:, None] * b / (a[:, None] + b))

    def reaches(t: pa.Table, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        n = t["n"].to_numpy().astype(float)
        asks = np.flatnonzero(t["near"].is_null().to_numpy())
        own = t["cell"].to_numpy()[:, None] == np.arange(len(cells.pivots))
        for a in range(0, len(asks), pivots.STRIP):
            at = asks[a : a + pivots.STRIP]
            # Some other cluster stands in each cell, but for one that the cluster has for itself.
            far = np.where(cells.counts > own[at], weighted(n[at], cells.largest) * (high[at] + cells.reach), np.inf).min(axis=1)
            d = weighted(n[at], n) * pivots.distances_to(x[at], x)
            d[np.arange(len(at)), at] = np.inf
            u = np.minimum(far, d.min(axis=1))
            yield at, u, cells.within(low[at], high[at], u, weighted(n[at], cells.least))

    return pivots.asking(cells, cells.rows, reaches, True, ["id", "x", "n"])


def ward_merges(x: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) of few centroids with sizes; a cluster goes by the lesser of its two."""
    d = pivots.distances_to(x, x) * np.sqrt(2 * n[:, None] * n / (n[:, None] + n))
    np.fill_diagonal(d, np.inf)
    n = n.copy()
    # Of each row the first of its nearest, kept from merge to merge.
    near = d.argmin(axis=1)
    least = d[np.arange(len(x)), near]
    for _ in range(len(x) - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        h = d[i, j]
        with np.errstate(invalid="ignore"):
            new = np.sqrt(np.maximum(0, ((n[i] + n) * d[i] ** 2 + (n[j] + n) * d[j] ** 2 - n * h**2) / (n[i] + n[j] + n)))
        new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        yield int(i), int(j), float(h)
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        n[i] += n[j]
        lost = (near == i) | (near == j)
        lost[[i, j]] = True, False
        nearer = (new < least) | ((new == least) & (i < near))
        least[nearer], near[nearer] = new[nearer], i
        lost = np.flatnonzero(lost)
        near[lost] = d[lost].argmin(axis=1)
        least[lost] = d[lost, near[lost]]
        least[j] = np.inf


def numbered(merges: DataFrame, copies: DataFrame) -> DataFrame:
    """Copies' merges and the others, with step (by height) before them."""
    first = copies.select(F.lit(0.0).alias("height"), "left", "right", "left_size", F.lit(1).cast("bigint").alias("right_size"))
    rows = materialise(first.unionByName(merges), "merges")
    got = positions(rows, F.col("height"), F.col("left"), F.col("right"), name="step")
    return got.select("step", "height", "left", "right", "left_size", "right_size")


def leaf_places(data: DataFrame, merges: DataFrame) -> DataFrame:
    """id, position from left to right; of two clusters the one with the lesser least row stands left."""
    rows = data.select(F.col("id").alias("node"))
    links = matched(rows, merges.select(F.col("right").alias("node"), F.col("left").alias("up"), F.col("left_size").alias("off")), "node", "left")
    links = climbed(links.select("node", F.coalesce("up", "node").alias("up"), F.coalesce("off", F.lit(0)).cast("bigint").alias("off")))
    return links.select(F.col("node").alias("id"), (F.col("off") + 1).cast("int").alias("position"))
