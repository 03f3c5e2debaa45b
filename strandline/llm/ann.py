"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample (iterative quantization, Gong & Lazebnik 2011) turns vectors into codes of up to 64
bits, cut into substrings. Every block of vectors holds one table for each substring. By the pigeonhole principle, a code
within Hamming radius r of a query agrees with it in some substring up to a share of r, so probing the tables at these shares
retrieves every code within r (Norouzi, Punjani & Fleet 2012): with r = m * c + a over m substrings, the first a + 1 are probed
at c and the others at c - 1. Some 64 queries with like codes probe together, one bit each, and what they retrieve is ranked by the
exact measure in double precision, after a first estimate in single precision with a margin for its error. The radius comes from
the sample: the quantile ``quantile`` of the distances of true neighbours there. Where fewer than k codes lie within it the
radius grows until there are k, so no query goes short.

Vectors of unequal norm get one more coordinate for the codes, which makes the largest inner product the nearest in angle.
Queries and vectors meet in blocks of bounded size; blocks' bests are merged by query. How much of a block probing can leave out
depends on the vectors: much if they form clusters, little if they are independent.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor those of another length
than the most common (ties: the shorter). Components of any finite size are scaled for codes and estimates; a score that
overflows is infinite, and one that isn't a number counts as the least. Ties of the measure go to smaller ids. Repeated ids: rows with
the query's own id are never its candidates, and an id counts once, with its best score. Of equal vectors in a block, the k + 1 with the smallest
ids are searched: no other can be among the k nearest. An empty table gives no rows. With fewer than k candidates all are given. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashes import U, mix, powers

BLOCK = 65_536  # vectors in a block
QUERIES = 16_384  # queries in a block
BATCH = 64  # queries that probe together
#: Of the error of an inner product of unit vectors in single precision.
MARGIN = 2e-5
#: Probed buckets that hold one row in so many, or more, are most of a block.
MOST_OF = 4


@dataclass
class Codes:
    """Scale, centre, rotation and reach of the codes: sign((x augmented - centre) @ rotation), cut into ``substrings``."""

    scale: float
    centre: np.ndarray
    rotation: np.ndarray
    norm: float
    radius: int
    substrings: int

    @property
    def width(self) -> int:
        return -(-self.rotation.shape[1] // self.substrings)

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Substring values of each vector, (rows, substrings). A query's extra coordinate is 0 and its norm is made the largest."""
        bits = augmented(x / self.scale, self.norm, query) - self.centre
        bits = (bits @ self.rotation) > 0
        pad = self.width * self.substrings - bits.shape[1]
        bits = np.pad(bits, ((0, 0), (0, pad))).reshape(len(x), self.substrings, self.width)
        return (bits * (1 << np.arange(self.width))).sum(axis=2).astype(np.uint32)


def augmented(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    if query:
        x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
        return np.column_stack([x * (norm / np.maximum(np.linalg.norm(x, axis=1), 1e-300))[:, None], np.zeros(len(x))])
    own = np.linalg.norm(x, axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - own**2, 0))])


def whole(codes: np.ndarray, width: int) -> np.ndarray:
    """All substrings of each code in one number."""
    return (codes.astype(U) << (np.arange(codes.shape[1]) * width).astype(U)).sum(axis=1, dtype=U)


def learn(x: np.ndarray, scale: float, norm: float, k: int, substrings: int = 8, bits: int = 64, quantile: float = 0.97, rounds: int = 30) -> Codes:
    """Principal directions, rotated by iterative quantization; the radius from the true k nearest within the sample."""
    z = augmented(x / scale, norm, False)
    centre = z.mean(axis=0)
    z = z - centre
    _, v = np.linalg.eigh(z.T @ z)
    v = v[:, ::-1][:, : min(bits, 64, z.shape[1])]
    y, rng = z @ v, np.random.default_rng(0)
    r = np.linalg.qr(rng.normal(size=(v.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(y @ r).T @ y)
        r = (u @ w).T
    codes = Codes(scale, centre, v @ r, norm, 0, min(substrings, v.shape[1]))
    if codes.width * codes.substrings > 64 or codes.width > 16:
        raise ValueError("the substrings must be of 16 bits at most, and of 64 together")
    some = x[: min(len(x), 512)]
    near = (some / scale) @ (x / scale).T
    near[np.arange(len(some)), np.arange(len(some))] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, max(1, len(x) - 1))]
    a, b = codes.encode(some, True), codes.encode(x, False)
    d = np.bitwise_count(a[:, None, :] ^ b[top]).sum(axis=2)
    codes.radius = int(np.ceil(np.quantile(d, quantile))) if d.size else 0
    return codes


class BlockIndex:
    """For each substring a table of buckets: the rows in order of their values, and where each value begins. Only probed buckets are read.

    Where those hold most of the block, its rows are looked at in place instead, which is as exact and faster than to gather them. ``read`` counts the rows
    of both.
    """

    def __init__(self, values: np.ndarray, width: int | None = None):
        self.width = int(values.max(initial=1)).bit_length() if width is None else width
        self.whole = whole(values, self.width)
        self.columns = [np.ascontiguousarray(c) for c in values.T]
        self.rows = [np.argsort(c, kind="stable").astype(np.int32) for c in self.columns]
        self.first = [np.searchsorted(c[r], np.arange((1 << self.width) + 1)) for c, r in zip(self.columns, self.rows)]
        self.read = 0

    def marked(self, s: int, mask: np.ndarray, hit: np.ndarray) -> None:
        """Adds the marks of substring s's values to the rows that have them."""
        some = np.flatnonzero(mask)
        start, n = self.first[s][some], self.first[s][some + 1] - self.first[s][some]
        total = int(n.sum())
        if MOST_OF * total >= len(hit):
            self.read += len(hit)
            hit |= mask[self.columns[s]]
        elif total:
            self.read += total
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(total)
            hit[self.rows[s][at]] |= np.repeat(mask[some], n)  # a row has one value

    def probe(self, asked: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that some of at most 64 queries retrieves, and which queries have them within their radius, (queries, rows)."""
        m, every = len(self.columns), np.arange(1 << self.width, dtype=np.uint32)
        c, a = np.divmod(radius, m)
        reach = c[:, None] - (np.arange(m)[None] > a[:, None])  # -1: not probed
        bit = U(1) << np.arange(len(asked)).astype(U)
        hit = np.zeros(len(self.whole), U)
        for s in range(m):
            near = np.bitwise_count(every[None] ^ asked[:, s, None]).astype(np.int64) <= reach[:, s, None]
            self.marked(s, np.where(near, bit[:, None], U(0)).sum(axis=0, dtype=U), hit)
        rows = np.flatnonzero(hit)
        inside = (hit[rows][None] & bit[:, None]) != 0
        inside &= np.bitwise_count(self.whole[rows][None] ^ whole(asked, self.width)[:, None]) <= radius[:, None]
        return rows, inside

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius of one code."""
        rows, inside = self.probe(code[None], np.array([radius]))
        return rows[inside[0]]


def searched(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of their ids, without repeated rows and without vectors that k + 1 smaller ids have too."""
    h = mix(np.ascontiguousarray(v + 0.0).view(U)) @ powers(0x9E3779B97F4A7C15, v.shape[1])
    order = np.lexsort((ids, h))
    h, i = h[order], ids[order]
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (v[order[1:]] == v[order[:-1]]).all(axis=1)])
    new = ~same | np.concatenate([[False], i[1:] != i[:-1]])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    ahead = np.cumsum(new) - 1
    keep = order[new & (ahead - ahead[start] <= k)]
    keep = keep[np.argsort(ids[keep], kind="stable")]
    return ids[keep], v[keep]


class BlockSearch:
    def __init__(self, codes: Codes, ids: np.ndarray, v: np.ndarray, k: int):
        self.k, self.codes = k, codes
        self.ids, self.v = searched(ids, v, k)
        self.repeated = bool((self.ids[1:] == self.ids[:-1]).any())
        self.distinct = len(np.unique(self.ids))
        self.index = BlockIndex(codes.encode(self.v, False), codes.width)
        self.single = (self.v / (np.abs(self.v).max() or 1.0)).astype(np.float32)
        self.largest = float(np.linalg.norm(self.single, axis=1).max())

    def scores(self, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            got = np.einsum("ij,ij->i", self.v[rows], asked)
        return np.where(np.isnan(got), -np.inf, got)

    def best(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For up to 64 queries (vectors, ids): positions of queries, rows and scores of their k best, in no order."""
        code = self.codes.encode(q, True)
        left, right = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        least = np.minimum(self.k, self.distinct - (right > left))
        radius, at = np.full(len(q), self.codes.radius), np.arange(len(q))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            rows, inside = self.index.probe(code[at], radius[at])
            for j, (a, b) in enumerate(zip(np.searchsorted(rows, left[at]), np.searchsorted(rows, right[at]))):
                inside[j, a:b] = False
            new = np.concatenate([[True], self.ids[rows][1:] != self.ids[rows][:-1]]) if len(rows) else np.zeros(0, bool)
            count = inside.sum(axis=1)
            if self.repeated and len(rows):
                count = np.logical_or.reduceat(inside, np.flatnonzero(new), axis=1).sum(axis=1)
            enough = count >= least[at]
            if enough.any() and len(rows):
                out.append(self.ranked(q[at[enough]], at[enough], rows, inside[enough]))
            at = at[~enough]
            radius[at] += self.codes.substrings
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def ranked(self, q: np.ndarray, name: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.repeated and len(rows) > 32 * self.k:
            unit = q / np.abs(q).max(axis=1, keepdims=True)
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
            near = unit @ (self.single if len(rows) == len(self.ids) else self.single[rows]).T
            near[~inside] = -np.inf
            # The k-th largest of the maxima of groups is no more than the k-th largest of all.
            groups = np.maximum.reduceat(near, np.arange(0, len(rows), max(1, len(rows) // (8 * self.k))), axis=1)
            floor = np.partition(groups, groups.shape[1] - self.k, axis=1)[:, groups.shape[1] - self.k]
            inside = inside & (near >= (floor - MARGIN * self.largest)[:, None])
        of, col = np.nonzero(inside)
        got = np.concatenate([self.scores(q[of[a : a + 65536]], rows[col[a : a + 65536]]) for a in range(0, len(of), 65536)]) if len(of) else np.zeros(0)
        ids = self.ids[rows[col]]
        order = np.lexsort((ids, -got, of))
        of, col, got, ids = of[order], col[order], got[order], ids[order]
        if self.repeated:  # the best row of each id
            first = np.sort(np.unique(np.column_stack([of, ids]), axis=0, return_index=True)[1])
            of, col, got = of[first], col[first], got[first]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        top = place < self.k
        return name[of[top]], rows[col[top]], got[top]


def vectors(table: pa.Table) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of those that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else -1))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, sample: int = 4096, block: int = BLOCK, queries: int = QUERIES, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = usable(embeddings.select("vec_id", "embedding"))
    n, scale = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))).first()[0]
    # Copies of a vector are drawn together, and count once.
    drawn = rows.select("v").where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(min(1e6, 1.5e6 * sample / n))).distinct()
    x = drawn.orderBy(F.xxhash64("v")).limit(sample).toArrow()  # ``sample`` vectors at most
    if not x.num_rows:
        x = rows.select("v").limit(1).toArrow()
    codes = learn(vectors(x), float(scale), float(np.sqrt(longest)) * (1 + 1e-12), k, **options)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nb, nq = max(-(-n // block), min(parts, -(-n // 8192))), -(-n // (every * queries))
    of = lambda blocks: F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    every_one = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # A row's block is chosen before its copies are made.
    data = rows.withColumn("b", of(nb)).withColumn("q", every_one(nq))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("q", of(nq)).withColumn("b", every_one(nb))
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key: tuple, data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return shape.empty_table()
        block = BlockSearch(codes, data.column("vec_id").to_numpy(), vectors(data), k)
        w, own = vectors(asked), asked.column("vec_id").to_numpy()
        order = np.argsort(whole(codes.encode(w, True), codes.width))  # like codes probe together
        out = []
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            q, r, s = block.best(w[at], own[at])
            out.append((own[at[q]], block.ids[r], s))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=shape)

    parts = max(parts, nb * nq)
    found = data.repartition(parts, "b", "q").groupBy("b", "q").cogroup(asked.repartition(parts, "b", "q").groupBy("b", "q")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
