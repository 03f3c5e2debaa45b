"""Rows in cells around pivots, and exact searches that leave out cells by the triangle inequality.

Each row is dealt to the nearest of a bounded number of pivots, and a cell is cut into parts of some ``PART`` rows. A first pass in each part
gives every row a bound on how far away what it looks for may be; the reach of each cell, and the planes halfway between its pivot and those next
to the row, say which cells can't hold it. The row is then sent to the parts of all other cells only. A part's rows are held in a task while
those that ask stream past them, so memory doesn't grow with the number that ask. While cells keep their size, the number that a row asks hardly
grows with the rows, in few dimensions; in many, all cells may have to be asked.

Distances are sums of squared differences in the order of the columns, so they are the same from both sides. A matrix product says which pairs
may be near enough, and those alone are measured. Bounds allow for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.staging import materialise
from .mixture import rows_of
from .sampling import sample_rows

#: Rows of a cell on the mean, pivots at most, rows of a part, and rows that ask at a time.
ROWS, MOST, PART, STRIP = 256, 2048, 1024, 256
#: Pivots next to a row whose planes it tries.
PLANES = 16
#: Rows of the table for which a part is held once; more ask in as many slices.
SLICE = 1 << 20
#: Of the norms: what rounding may change in a distance to a pivot.
ROUNDING = 1e-7


@dataclass
class Cells:
    """``rows``: the columns dealt, cell, part, and r (distance to the pivot). The rest are numbers a cell: rows, parts, the largest r, and the least and largest size."""

    rows: DataFrame
    n: int
    pivots: np.ndarray
    counts: np.ndarray
    parts: np.ndarray
    reach: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def __getstate__(self) -> dict:
        """Tasks take the numbers alone."""
        return {k: v for k, v in self.__dict__.items() if k != "between"} | {"rows": None}

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bounds(x, self.pivots)

    @cached_property
    def between(self) -> np.ndarray:
        """Twice the distances of pivots; infinite where there is no plane between them, as of a pivot and itself."""
        d = 2 * distances_to(self.pivots, self.pivots)
        return np.where(d > 0, d, np.inf)

    def within(self, low: np.ndarray, high: np.ndarray, u: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """A mask (rows, cells) of the cells that may hold a row within u, from bounds of the distances to the pivots; ``weight`` is what distances to a cell are taken by, at least.

        A cell's rows are no nearer to another pivot than to their own, so they stand behind the plane halfway to it.
        """
        near = np.maximum(0, low - self.reach)
        mask = ((near if weight is None else weight * near * (1 - ROUNDING)) <= u[:, None]) & (self.counts > 0)
        i, c = np.nonzero(mask)
        norm = np.sqrt(((self.pivots - self.pivots.mean(axis=0)) ** 2).sum(axis=1))
        # Rows may be nearer to another pivot by what rounding hid when they were dealt.
        slack = 8 * ROUNDING * (norm + self.reach).max() * self.reach
        low = np.maximum(0, low)
        m = min(PLANES, len(self.pivots))
        next_to = np.argpartition(high, m - 1, axis=1)[:, :m]
        next_to = np.take_along_axis(next_to, np.argsort(np.take_along_axis(high, next_to, axis=1), axis=1), axis=1)
        for k in range(m):
            p = next_to[i, k]
            gap = (low[i, c] ** 2 - high[i, p] ** 2 - slack[c]) / self.between[p, c]
            if weight is not None:
                gap = gap * weight[i, c]
            keep = gap * (1 - ROUNDING) <= u[i]
            i, c = i[keep], c[keep]
        mask[:] = False
        mask[i, c] = True
        return mask

    @property
    def tasks(self) -> int:
        """Partitions for searches, given as a number because work doesn't follow bytes."""
        return max(1, min(int(self.parts.sum()), int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def bounds(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of rows to pivots, by a matrix product."""
    centre = pivots.mean(axis=0)
    a, b = x - centre, pivots - centre
    aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
    d = np.sqrt(np.maximum(aa + bb - 2 * (a @ b.T), 0))
    slack = ROUNDING * (np.sqrt(aa) + np.sqrt(bb)) + 1e-300
    return d - slack, d + slack


def distances_to(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - y[:, j]) ** 2
    return np.sqrt(d, out=d)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def deal(data: DataFrame, rows: int = ROWS, most: int = MOST, part: int = PART, seed: int = 1, size: str | None = None) -> Cells:
    """Cells of the rows (id, x, any other columns). Pivots are rows drawn by a hash of their ids; ``size`` names a column whose range by cell is kept."""
    n = data.count()
    drawn = sample_rows(data.select("id", "x"), max(1, min(most, -(-n // rows))), seed).collect()  # ``most`` rows at most
    if not drawn:
        raise ValueError("there are no rows")
    pivots = np.unique(np.array([r["x"] for r in drawn], float), axis=0)
    schema = StructType([*data.schema.fields, StructField("cell", IntegerType()), StructField("r", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x = rows_of(piece)
            cell = bounds(x, pivots)[1].argmin(axis=1)
            r = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cell, pa.int32()), pa.array(r)], schema.names)

    table = materialise(data.mapInArrow(run, schema), "cells")
    weight = F.col(size) if size else F.lit(1)
    m = len(pivots)
    counts, reach, least, largest = np.zeros(m, np.int64), np.zeros(m), np.ones(m), np.ones(m)
    for s in table.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("reach"), F.min(weight).alias("least"), F.max(weight).alias("largest")).collect():
        counts[s["cell"]], reach[s["cell"]], least[s["cell"]], largest[s["cell"]] = s["n"], s["reach"], s["least"], s["largest"]
    parts = np.maximum(1, -(-counts // part))
    own = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)
    table = table.withColumn("part", F.pmod(F.xxhash64("id"), own).cast("int"))
    return Cells(table, n, pivots, counts, parts, reach * (1 + ROUNDING), least, largest)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        for key, piece in stretches(batch, keys):
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    if not batch.num_rows:
        return
    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    change = np.zeros(batch.num_rows, bool)
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(c[a] for c in cols), batch.slice(a, b - a)


#: From rows, their x, and lower and upper bounds of their distances to the pivots: some of the rows at a time, how far each looks, and a mask (rows, cells).
Reaches = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def asking(cells: Cells, rows: DataFrame, reaches: Reaches, by_part: bool, columns: list[str]) -> DataFrame:
    """The rows, once for each part of each cell that ``reaches`` says, with the bound ``u`` that it gives: ``columns``, u, cell, part.

    With ``by_part`` it is given all rows of a part together.
    """
    names = [*columns, "u", "cell"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["cell", "part"]) if by_part else (pa.Table.from_batches([p]) for p in pieces(batches)):
            t = t.combine_chunks()
            x = rows_of(t["x"].combine_chunks())
            for at, u, mask in reaches(t, x, *cells.bounds(x)):
                i, c = np.nonzero(mask)
                if len(i):
                    piece = t.select(columns).take(pa.array(at[i]))
                    yield from pa.table([*piece.columns, pa.array(u[i]), pa.array(c, pa.int32())], names).to_batches()

    if by_part:
        rows = rows.repartition(cells.tasks, "cell", "part").sortWithinPartitions("cell", "part")
    asked = rows.mapInArrow(run, f"{kinds}, u double, cell int")
    parts = F.element_at(F.array(*[F.lit(int(p)) for p in cells.parts]), F.col("cell") + 1)
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))


def search(cells: Cells, rows: DataFrame, asked: DataFrame, k: int, label: str | None = None, size: str | None = None) -> DataFrame:
    """id, neighbour, distance (and the neighbour's label): of each part that a row asks, its k nearest within u, equals by id; a row isn't its own.

    With a label, rows of the same label aren't compared. With a size, the distance is Ward's between centroids of so many rows.
    """
    extra = [c for c in (label, size) if c]
    named = ["cell", "part", "slice", "kind", "id", "x", "u", *extra]
    slices = -(-cells.n // SLICE)
    given = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("kind", F.lit(0)).withColumn("u", F.col("r")).select(*named)
    wanted = asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("kind", F.lit(1)).select(*named)
    both = given.unionByName(wanted).repartition(cells.tasks, "cell", "part", "slice").sortWithinPartitions("cell", "part", "slice", "kind", "id")
    kind = rows.schema["id"].dataType.simpleString()
    out = ["id", "neighbour", "distance", *(["label"] if label else [])]

    def compare(have: pa.RecordBatch, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, y = have["id"].to_numpy(zero_copy_only=False), rows_of(have)
        centre = y.mean(axis=0)
        z = y - centre
        zz = (z * z).sum(axis=1)
        for p in pieces(iter([asks]), STRIP):
            own, u, x = p["id"].to_numpy(zero_copy_only=False), p["u"].to_numpy(), rows_of(p)
            a = x - centre
            aa = (a * a).sum(axis=1)
            # Squared distances less what rounding may have added.
            d = a @ (-2 * z.T)
            d += (aa * (1 - ROUNDING))[:, None]
            d += zz * (1 - ROUNDING)
            if size:
                n, m = p[size].to_numpy().astype(float), have[size].to_numpy().astype(float)
                d *= 2 * n[:, None] * m / (n[:, None] + m)
            i, j = np.nonzero(d <= (u * u * (1 + ROUNDING))[:, None])
            use = own[i] != ids[j]
            if label:
                use &= p[label].to_numpy(zero_copy_only=False)[i] != have[label].to_numpy(zero_copy_only=False)[j]
            i, j = i[use], j[use]
            d = np.zeros(len(i))
            for c in range(x.shape[1]):
                d += (x[i, c] - y[j, c]) ** 2
            d = np.sqrt(d)
            if size:
                d *= np.sqrt(2 * n[i] * m[j] / (n[i] + m[j]))
            use = d <= u[i]
            i, j, d = i[use], j[use], d[use]
            order = np.lexsort((j, d, i))  # the part is in order of ids
            i, j, d = i[order], j[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k  # the k nearest of each
            i, j, d = i[first], j[first], d[first]
            cols = [p["id"].take(pa.array(i)), have["id"].take(pa.array(j)), pa.array(d)]
            yield pa.RecordBatch.from_arrays(cols + ([have[label].take(pa.array(j))] if label else []), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, have = None, [], None
        for batch in batches:
            for (*new, kind), piece in stretches(batch, ["cell", "part", "slice", "kind"]):
                if new != key:
                    key, held, have = new, [], None
                if kind == 0:
                    held.append(piece)
                elif held:
                    if have is None:
                        have = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield from compare(have, piece)

    labelled = f", label {rows.schema[label].dataType.simpleString()}" if label else ""
    return both.mapInArrow(run, f"id {kind}, neighbour {kind}, distance double{labelled}")


def kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest of each row; infinite if there are fewer."""
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def nearest_asked(cells: Cells, k: int) -> DataFrame:
    """Which rows ask which parts for their k nearest, another row than themselves: bounds come from the row's own part, and from the sizes and reach of cells."""

    def reaches(t: pa.Table, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        far = high + cells.reach
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(cells.counts[order], axis=1) >= k + 1).argmax(axis=1)
        u = far[np.arange(len(x)), order[np.arange(len(x)), enough]] if cells.n > k else np.full(len(x), np.inf)
        for a in range(0, len(x), STRIP):
            at = np.arange(a, min(len(x), a + STRIP))
            best = np.minimum(u[at], kth(distances_to(x[at], x), k + 1))  # the row itself is one of them
            yield at, best, cells.within(low[at], high[at], best)

    return asking(cells, cells.rows, reaches, True, ["id", "x"])


def nearest(cells: Cells, k: int) -> DataFrame:
    """id, neighbour, distance: the k nearest other rows of each, equals by id."""
    found = search(cells, cells.rows, nearest_asked(cells, k), k)
    return best_of(found, k).drop("rank")


def best_of(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
