"""Best-fit packing after Martello-Toth dominance reduction, on the histogram of lengths.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the driver packs the histogram: a bounded
table whatever the corpus size. The reduction permanently fixes bins of one or two pieces that provably dominate every other
bin with that piece; best fit packs the rest, always on whole groups of equal bins. Each piece then finds its place from its
length and its rank among the pieces of that length. Ranks come from a count by task and a prefix sum over tasks, so no
window or group ever holds the rows of one length.

Defined cases: a null or empty text is one piece with the end id alone. Documents longer than the capacity are cut into full
pieces, the first of which may be shorter. Ties between equal lengths go by task and row order. Repeated rows are packed each.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import each, materialise, tidy

Runs = tuple[tuple[int, int], ...]  # (length, copies) inside one bin


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Runs, int]], dict[int, int]]:
    """Martello-Toth reduction: bins fixed for good as (runs, how many), and the counts that remain.

    For a piece j with room r beside it and i the largest other piece that fits: {j} is fixed if nothing fits, and {j, i} if i
    fills the room, if no two others fit together, or if no three fit and no two together exceed i.
    """
    left, fixed = {k: v for k, v in counts.items() if v}, []
    keys = sorted(left)

    def without(j: int, n: int) -> list[int]:
        """The n smallest pieces beside one copy of j."""
        out: list[int] = []
        for k in keys:
            out += [k] * min(n - len(out), left[k] - (k == j))
            if len(out) == n:
                break
        return out

    def largest(j: int, room: int) -> int:
        at = bisect.bisect_right(keys, room) - 1
        if at >= 0 and keys[at] == j and left[j] < 2:
            at -= 1
        return keys[at] if at >= 0 else 0

    def pair_above(j: int, room: int, least: int) -> bool:
        """Whether two pieces beside one copy of j come to more than ``least`` and still fit."""
        have = [k for k in keys if k <= room and left[k] > (k == j)]
        lo, hi = 0, len(have) - 1
        while lo <= hi:
            total = have[lo] + have[hi]
            if total > room:
                hi -= 1
            elif total > least and (lo < hi or left[have[lo]] - (have[lo] == j) > 1):
                return True
            else:
                lo += 1
        return False

    changed = True
    while changed:
        changed = False
        for j in sorted(keys, reverse=True):
            while left.get(j):
                room, small = capacity - j, without(j, 3)
                i = largest(j, room)
                if not i:
                    fixed.append((((j, 1),), left[j]))
                    take = {j: left[j]}
                elif i == room or len(small) < 2 or sum(small[:2]) > room or ((len(small) < 3 or sum(small) > room) and not pair_above(j, room, i)):
                    m = left[j] // 2 if i == j else min(left[j], left[i])
                    fixed.append((((j, 2),) if i == j else ((j, 1), (i, 1)), m))
                    take = {j: 2 * m} if i == j else {j: m, i: m}
                else:
                    break
                changed = True
                for k, v in take.items():
                    left[k] -= v
                    if not left[k]:
                        del left[k]
                        keys.remove(k)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """Best fit, longest pieces first, on groups of equal bins: each length goes to the fullest bins that still have room."""
    groups: dict[int, list[tuple[Runs, int]]] = {}
    rooms: list[int] = []

    def add(room: int, runs: Runs, n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((runs, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                runs, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, runs, bins = capacity, (), -(-n // (capacity // length))
            each = room // length
            full = min(bins, n // each)
            add(room - each * length, (*runs, (length, each)), full)
            n -= full * each
            if full < bins:
                some = 0
                if n:
                    some, rest = 1, n
                    add(room - rest * length, (*runs, (length, rest)), 1)
                    n = 0
                if runs:
                    add(room, runs, bins - full - some)
    return [g for gs in groups.values() for g in gs]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length its slots: rows (first rank, first sequence, copies in a bin, offset of the first copy)."""
    fixed, left = reduce_dominated(counts, capacity)
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for runs, bins in fixed + best_fit(left, capacity):
        offset = 0
        for length, each in runs:
            slots.setdefault(length, []).append((used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + each * bins
            offset += each * length
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, the task and rank in the task among its pieces of that length, and columns of the document named by ``carry``."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for batch in tidy(batches):
            rows, owner = [], []
            for d, ids in enumerate(enc.encode(each(batch.column(1)))):
                ids = np.concatenate([np.frombuffer(ids, enc.dtype).astype("<u4"), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]))
                    seen[length] += 1
                    owner.append(d)
            cols = np.array(rows, np.int64).reshape(-1, 5)
            own = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, c]) for c in (1, 2, 3)), pa.array(np.full(len(cols), task, np.int32)), pa.array(cols[:, 4]), *(c.take(own) for c in batch.columns[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *carry],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *[f"`{c}`" for c in carry]).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece, and columns of its document named by ``carry``."""
    table = materialise(pieces(docs, capacity, end_id, path, carry), "pieces")
    by_task = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = plan(histogram, capacity)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        out = np.zeros((len(n), 2), np.int64)
        for k in np.unique(n):
            at, table = np.flatnonzero(n == k), slots[int(k)]
            s = table[np.searchsorted(table[:, 0], r[at], "right") - 1]
            q = r[at] - s[:, 0]
            out[at, 0], out[at, 1] = s[:, 1] + q // s[:, 2], s[:, 3] + q % s[:, 2] * k
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["sequence_id", "offset"])

    ranked = table.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    placed = ranked.withColumn("p", place.asNondeterministic()(F.col("length"), F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset", *[f"`{c}`" for c in carry])
