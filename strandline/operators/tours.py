"""Open tours through rows: from one end of the farthest pair, by construction heuristics (Rosenkrantz, Stearns & Lewis 1977).

A tour is sequential: every step needs the one before. So a tour runs inside one task per group, in memory that grows with the
rows alone (``routes``), whatever their number; groups and candidate column sets run side by side. The methods here say what the tours are,
by a table of all distances: ``open_path`` takes ``MOST`` rows, and the tests hold ``routes`` against it. The farthest pair alone is also found by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import total, vector
from .mixture import column_summary, rows_of
from .routes import route

MOST = 5_000

#: Blocks that rows are dealt to before blocks grow, and the rows to which they grow before there are more of them; tasks that pairs of blocks are dealt to at most.
BLOCKS, LARGEST, TASKS = 64, 16_384, 4_096


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs of rows."""
    out = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        c = x[:, j]
        out += (c[:, None] - c) ** 2
    return np.sqrt(out)


def ends(dist: np.ndarray) -> tuple[int, int]:
    """The farthest pair (start, end), start > end; of equals the one with the smallest end, then start."""
    low = np.where(np.tri(len(dist), k=-1, dtype=bool), dist, -1).T  # row: end, column: start
    end, start = np.unravel_index(int(np.argmax(low)), low.shape)
    return int(start), int(end)


def nearest_neighbour(dist: np.ndarray, start: int, end: int) -> list[int]:
    path, free = [start], np.ones(len(dist), bool)
    free[start] = False
    while free.any():
        path.append(int(np.argmin(np.where(free, dist[path[-1]], np.inf))))
        free[path[-1]] = False
    return path


def insertion(choose: str) -> Callable[[np.ndarray, int, int], list[int]]:
    """Insertion heuristics on the path start..end: the next row is the farthest from the path, the nearest, or the cheapest."""

    def tour(dist: np.ndarray, start: int, end: int) -> list[int]:
        path, free = [start, end], np.ones(len(dist), bool)
        free[path] = False
        near = np.minimum(dist[start], dist[end])
        while free.any():
            a, b = np.array(path[:-1]), np.array(path[1:])
            if choose == "cheapest":
                rest = np.flatnonzero(free)
                cost = dist[a][:, rest] + dist[b][:, rest] - dist[a, b][:, None]
                node = rest[int(np.argmin(cost.min(axis=0)))]
            else:
                node = int(np.argmax(np.where(free, near, -np.inf)) if choose == "farthest" else np.argmin(np.where(free, near, np.inf)))
            at = int(np.argmin(dist[a, node] + dist[b, node] - dist[a, b]))
            path.insert(at + 1, int(node))
            free[node] = False
            near = np.minimum(near, dist[node])
        return path

    return tour


def two_opt(dist: np.ndarray, start: int, end: int) -> list[int]:
    """Reversals of inner stretches of the nearest-neighbour path until none shortens it; its first row stays first."""
    path = nearest_neighbour(dist, start, end)
    better = True
    while better:
        better = False
        for i in range(1, len(path) - 1):
            p = np.array(path)
            j = np.arange(i + 1, len(p))
            after = np.append(p[1:], -1)[j]
            gain = dist[p[i - 1], p[i]] - dist[p[i - 1], p[j]]
            gain += np.where(after >= 0, dist[p[j], after] - dist[p[i], after], 0)
            best = int(np.argmax(gain))
            if gain[best] > 1e-12:
                path[i : j[best] + 1] = path[i : j[best] + 1][::-1]
                better = True
    return path


METHODS = {
    "nn": nearest_neighbour,
    "farthest_insertion": insertion("farthest"),
    "nearest_insertion": insertion("nearest"),
    "cheapest_insertion": insertion("cheapest"),
    "two_opt": two_opt,
}


def method_named(method: str):
    if method not in METHODS:
        raise ValueError(f"no such method: {method}; there are {', '.join(METHODS)}")
    return METHODS[method]


def open_path(x: np.ndarray, method: str = "nn") -> list[int]:
    """Row numbers along the tour, by a table of distances; rows must stand in the order that breaks ties. ``routes.route`` takes any number of rows."""
    if len(x) > MOST:
        raise ValueError(f"a table of distances takes at most {MOST} rows, and here are {len(x)}")
    if len(x) < 2:
        return list(range(len(x)))
    dist = distances(x)
    return method_named(method)(dist, *ends(dist))


def path_length(x: np.ndarray, path: list[int], normalise: bool = False) -> float:
    y = x[path]
    if normalise:
        if y.shape[1] == 1:
            return 0.0
        s = y.sum(axis=1, keepdims=True)
        if (s == 0).any():
            raise ValueError("a row sums to zero: it can't be normalised")
        y = y / s
    return float(np.sqrt(((y[1:] - y[:-1]) ** 2).sum(axis=1)).sum())


def tour(data: DataFrame, method: str = "nn", group: str | None = None) -> DataFrame:
    """id, position along the open tour; with ``group``, a tour of its own for each, and the group as a string column."""
    method_named(method)
    key = F.lit("all") if group is None else F.col(group).cast("string")
    rows = data.select(key.alias("group"), "id", "x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        path = route(np.stack(pdf["x"]), method)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "id": pdf["id"].to_numpy()[path], "position": np.arange(1, len(path) + 1)})

    kind = data.schema["id"].dataType.simpleString()
    if group is not None:
        # Given as a number: tours take time, not bytes, and Spark would join small partitions into one task.
        rows = rows.repartition(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    out = rows.groupBy("group").applyInPandas(run, f"group string, id {kind}, position int")
    return out.drop("group") if group is None else out


def in_block_pairs(data: DataFrame, block: int, n: int) -> DataFrame:
    """a, b, own, id, x: rows dealt to blocks of some ``block`` rows, each copied to the pairs (a, b) of blocks that its own is in.

    There are at most ``BLOCKS`` blocks, unless they would hold more than ``LARGEST`` rows, so up to BLOCKS * LARGEST rows what is shuffled grows as the input does.
    """
    blocks = max(1, -(-n // LARGEST), min(BLOCKS, -(-n // block)))
    rows = data.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    rows = rows.select("id", "x", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "x")
    # Given as a number: pairs take time, not bytes, and Spark would join small partitions into one task.
    return rows.repartition(min(blocks * (blocks + 1) // 2, TASKS), "a", "b")


def strips(t: pa.Table, cells: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the rows of a pair of blocks in order of id, some at a time: the first of them, their distances to all, and which pairs count.

    Pairs are those with the larger id first, and in a pair of different blocks those across them.
    """
    x, own = rows_of(t["x"].combine_chunks()), t["own"].to_numpy()
    one_block, rows = t["a"][0] == t["b"][0], max(1, cells // len(x))
    for at in range(0, len(x), rows):
        part, d = x[at : at + rows], np.zeros((min(rows, len(x) - at), len(x)))
        for j in range(x.shape[1]):
            d += (part[:, j, None] - x[:, j]) ** 2
        use = np.arange(len(x)) < at + np.arange(len(part))[:, None]
        if not one_block:
            use &= own[at : at + rows, None] != own
        yield at, np.sqrt(d), use


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Not negative numbers rounded as DuckDB's SQL rounds them: halves of the scaled number go up; what overflows when scaled stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = d * 10.0**digits
        near = np.rint(scaled)
        scaled -= near
        near += scaled == 0.5  # halves that went down to an even number
    near /= 10.0**digits
    return near if np.isfinite(near).all() else np.where(np.isfinite(near), near, d)


def pairs_across(t: pa.Table, cells: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a pair of blocks, larger ids, smaller ids and distances of all pairs across them, or within the one: some ``cells`` at a time, so that they stay in a core's cache."""
    t = t.sort_by("id")
    ids, x, own = t["id"].to_numpy(), rows_of(t["x"].combine_chunks()), t["own"].to_numpy()
    one_block = t["a"][0] == t["b"][0]
    first = slice(None) if one_block else own == own[0]
    second = first if one_block else own != own[0]
    id_a, id_b, a, b = ids[first], ids[second], np.ascontiguousarray(x[first].T), np.ascontiguousarray(x[second].T)
    rows = max(1, cells // max(1, len(id_b)))
    for at in range(0, len(id_a), rows):
        strip = slice(at, min(at + rows, len(id_a)))
        until = strip.stop if one_block else len(id_b)
        d = np.zeros((strip.stop - at, until))
        square = np.empty_like(d)
        for u, v in zip(a, b):
            np.subtract(u[strip, None], v[:until], out=square)
            np.multiply(square, square, out=square)
            d += square
        np.sqrt(d, out=d)
        i, j = id_a[strip, None], id_b[:until]
        if one_block:
            p, q = np.nonzero(np.arange(until) < np.arange(at, until)[:, None])
            yield i[p, 0], j[q], d[p, q]
        else:
            yield np.maximum(i, j).ravel(), np.minimum(i, j).ravel(), d.ravel()


def pairwise(data: DataFrame, block: int = 2048, digits: int | None = None) -> DataFrame:
    """i, j, distance for i > j, by pairs of blocks; with ``digits``, rounded as SQL rounds. The result grows with the square of the rows, whatever makes it.

    Tasks hand pairs on as they make them, so they hold the rows of two blocks and a strip of pairs.
    """
    kind = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        for i, j, d in pairs_across(t):
            d = d if digits is None else rounded(d, digits)
            yield pa.RecordBatch.from_arrays([pa.array(i, t["id"].type), pa.array(j, t["id"].type), pa.array(d)], names=["i", "j", "distance"])

    return in_block_pairs(data, block, data.count()).groupBy("a", "b").applyInArrow(run, f"i {kind}, j {kind}, distance double")


def far_rows(data: DataFrame) -> DataFrame:
    """The rows that may be in a farthest pair. A pair at distance L has one row at least L - R from the mean, if no row is farther than R.

    L is the distance between two rows found by going twice from one to the farthest from it, so three passes leave few rows of most data.
    """
    mean = column_summary(data)["mean"]
    away = lambda v: F.sqrt(total(F.zip_with("x", vector(v), lambda a, b: (a - b) * (a - b))))
    farthest = lambda v: data.select("x", away(v).alias("r")).agg(F.max(F.struct("r", "x")).alias("m")).first()["m"]
    first = farthest(mean)
    second = farthest(np.array(first["x"]))
    least = max(second["r"], farthest(np.array(second["x"]))["r"])
    return data.where(away(mean) >= F.lit(float((least - first["r"]) * (1 - 1e-9) - 1e-12)))


def farthest_pair(data: DataFrame, block: int = 2048) -> DataFrame:
    """start, end, distance of the farthest pair (start > end; of equals the smallest end, then start).

    Rows that are too near the mean are left out; the others are dealt to blocks, blocks are paired, and a pair of blocks gives its
    one best pair.
    """
    kind = data.schema["id"].dataType.simpleString()
    n = data.count()
    rows = far_rows(data.select("id", "x")) if n > block else data
    n = rows.count() if n > block else n

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, best = t["id"].to_numpy(), None
        for at, d, use in strips(t):
            d[~use] = -1
            top = d.max(initial=-1)
            if top >= 0:
                i, j = np.nonzero(d == top)
                got = min((-top, ids[b], ids[at + a]) for a, b in zip(i, j))
                best = got if best is None or got < best else best
        rows = [best] if best else []
        return pa.table({"start": pa.array([r[2] for r in rows], t["id"].type), "end": pa.array([r[1] for r in rows], t["id"].type), "distance": pa.array([-r[0] for r in rows], pa.float64())})

    best = in_block_pairs(rows, block, n).groupBy("a", "b").applyInArrow(run, f"start {kind}, end {kind}, distance double")
    return best.orderBy(F.desc("distance"), "end", "start").limit(1)
