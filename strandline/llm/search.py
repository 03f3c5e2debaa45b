"""Ranked lexical search: documents scored one at a time by a heap merge over compressed postings, shard by shard.

Each task cuts its documents into shards of bounded size. A shard is one row: its documents in ascending order of their ids with their lengths, its
terms, and for each term the postings as one run of variable-length bytes (gaps between documents, and occurrences). The index is
written once, without a shuffle; it is fit for any queries.

Queries are dealt into blocks of some ``BLOCK_TERMS`` terms, and one block at a time is broadcast. A first narrow pass over the terms of all
shards counts the documents that hold each of the block's terms; a second decodes the postings of those terms and searches. There every
query walks through a shard document by document: a heap holds the next document of each term, all terms of the least one
are taken together and its score is complete before the next is looked at. A heap of the k best, keyed by score and then by id, goes on from
shard to shard within a task. Terms whose largest possible contributions together stay below the k-th best score can't bring in a
document by themselves: they leave the merge, and are only looked up for documents that other terms bring (MaxScore, Turtle & Flood
1995). So nothing is left out that could be among the k best. Each task gives its k best for each query, and a window merges them.

Defined cases: terms are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null, empty and wordless documents aren't found and aren't
counted. Null and wordless queries find nothing; rows of one query id are one query with all their terms, a null id is none. Repeated terms of a query
count each time. Rows that repeat an id are documents of their own. A document without an id counts and is found, after others
of its score. Scores of 0 aren't given. Very long texts are read in slices, and a document has its place in one shard. Without documents or
queries there are no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, raw_texts, text_column, tidy, word_slices

#: Documents and bytes of text in a shard; terms, over all its queries, in a block of queries.
SHARD_DOCS, SHARD_BYTES, BLOCK_TERMS = 4096, 1 << 23, 1 << 19
#: The place of a document without an id: after every id.
NAMELESS = 1 << 63
INDEX = "n_docs bigint, n_terms bigint, ids array<bigint>, sizes array<bigint>, terms array<binary>, dfs array<bigint>, ends array<bigint>, postings binary"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (seven bits each, the last one below 128) of whole numbers, and where each number ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        use = size > k
        more = np.where(size[use] > k + 1, 128, 0)
        out[ends[use] - size[use] + k] = ((values[use] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        use = starts + k <= ends
        out[use] |= (data[starts[use] + k].astype(np.int64) & 127) << 7 * k
    return out


def shard(ids: list[int | None], counts: list[dict[bytes, int]]) -> pa.RecordBatch:
    """One row of the index, from the terms of each document."""
    order = sorted(range(len(ids)), key=lambda d: NAMELESS if ids[d] is None else ids[d])
    names: dict[bytes, int] = {}
    for d in order:
        for t in counts[d]:
            names.setdefault(t, len(names))
    kinds = np.array([len(counts[d]) for d in order])
    term = np.fromiter((names[t] for d in order for t in counts[d]), np.int64, int(kinds.sum()))
    tf = np.fromiter((n for d in order for n in counts[d].values()), np.int64, len(term))
    doc = np.repeat(np.arange(len(order)), kinds)
    by = np.argsort(term, kind="stable")  # documents of a term stay in order
    term, tf, doc = term[by], tf[by], doc[by]
    new = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
    gap = np.where(new, doc, doc - np.concatenate([[0], doc[:-1]])) if len(term) else doc
    data, ends = packed(np.column_stack([gap, tf]).ravel())
    last = np.flatnonzero(np.concatenate([new[1:], [True]])) if len(term) else np.zeros(0, int)
    sizes = np.array([sum(counts[d].values()) for d in order], np.int64)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), one([ids[d] for d in order], pa.int64()), one(sizes, pa.int64()), one(list(names), pa.binary()),
            one(np.bincount(term, minlength=len(names)), pa.int64()), one(ends[2 * last + 1], pa.int64()), pa.array([data.tobytes()], pa.binary()),
        ],
        ["n_docs", "n_terms", "ids", "sizes", "terms", "dfs", "ends", "postings"],
    )


def build(docs: DataFrame, most_docs: int = SHARD_DOCS, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index: a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, size = [], [], 0
        for batch in tidy(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                found: Counter[bytes] = Counter()
                for ws in word_slices(raw):
                    found.update(ws)
                if not found:
                    continue
                ids.append(doc)
                counts.append(found)
                size += len(raw)
                if len(ids) >= most_docs or size >= most_bytes:
                    yield shard(ids, counts)
                    ids, counts, size = [], [], 0
        if ids:
            yield shard(ids, counts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, INDEX)


@dataclass
class Block:
    """Queries of one block: each a list of (number of a term, how often), and the terms in binary order."""

    terms: pa.Array
    queries: list[list[tuple[int, int]]]
    weights: list[int]

    def numbers(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in a shard's terms that the block has, and their numbers in it."""
        at = pc.index_in(terms, value_set=self.terms)
        have = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        return have, at.take(pa.array(have)).to_numpy(zero_copy_only=False).astype(np.int64)


class Shard:
    """The postings of a block's terms in one shard, with what each document gains by each."""

    def __init__(self, row: dict, block: Block, docs: int, total: int):
        at, number = block.numbers(row["terms"].values)
        ends, dfs = (row[c].values.to_numpy() for c in ("ends", "dfs"))
        self.ids = [NAMELESS if i is None else i for i in row["ids"].as_py()]
        m = np.array([75 + (25 * n * docs) // total for n in row["sizes"].as_py()], np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        weight = np.array(block.weights, np.int64)[number]
        at, number, weight = at[weight > 0], number[weight > 0], weight[weight > 0]
        raw = row["postings"].as_buffer()
        data = np.frombuffer(raw, np.uint8) if raw.size else np.zeros(0, np.uint8)
        values = unpacked(np.concatenate([data[starts[k] : ends[k]] for k in at]) if len(at) else data[:0])
        gap, tf = values[0::2], values[1::2]
        cut = np.concatenate([[0], np.cumsum(dfs[at])])
        doc = np.cumsum(gap)
        doc -= np.repeat(doc[cut[:-1]] - gap[cut[:-1]], dfs[at]) if len(at) else 0
        gain = np.repeat(weight, dfs[at]) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        best = np.maximum.reduceat(gain, cut[:-1]).tolist() if len(at) else []
        self.lists = {k: (doc[a:b].tolist(), gain[a:b].tolist(), top) for k, a, b, top in zip(number.tolist(), cut[:-1], cut[1:], best)}


def walk(part: Shard, query: list[tuple[int, int]], best: list[tuple[int, int]], k: int) -> None:
    """Score the shard's documents one at a time for a query; ``best`` is a heap of (score, -id), at most k."""
    terms = sorted(((part.lists[t][2] * times, t, times) for t, times in query if t in part.lists and part.lists[t][2]), key=lambda x: x[0])
    if not terms:
        return
    docs, gains, times = [part.lists[t][0] for _, t, _ in terms], [part.lists[t][1] for _, t, _ in terms], [n for *_, n in terms]
    reach = [0]  # the most that the first terms can bring together
    for top, *_ in terms:
        reach.append(reach[-1] + top)
    floor = best[0][0] if len(best) == k else 1
    n, aside, shift, ids = len(terms), 0, len(terms).bit_length(), part.ids
    while aside < n and reach[aside + 1] < floor:
        aside += 1
    mask, at = (1 << shift) - 1, [0] * n
    merge = [docs[j][0] << shift | j for j in range(aside, n)]
    heapq.heapify(merge)
    while merge:
        doc, score = merge[0] >> shift, 0
        while merge and merge[0] >> shift == doc:
            j = merge[0] & mask
            p = at[j]
            score += gains[j][p] * times[j]
            at[j] = p = p + 1
            if p < len(docs[j]):
                heapq.heapreplace(merge, docs[j][p] << shift | j)
            else:
                heapq.heappop(merge)
        for j in range(aside - 1, -1, -1):
            if score + reach[j + 1] < floor:
                break
            at[j] = p = bisect_left(docs[j], doc, at[j])
            if p < len(docs[j]) and docs[j][p] == doc:
                score += gains[j][p] * times[j]
        if score < floor:
            continue
        entry = (score, -ids[doc])
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == k and best[0][0] > floor:
            floor = best[0][0]
            before = aside
            while aside < n and reach[aside + 1] < floor:
                aside += 1
            if aside > before:
                merge = [e for e in merge if e & mask >= aside]
                heapq.heapify(merge)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term, times."""
    kind = queries.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at, raw in enumerate(raw_texts(batch.column(1))):
                for ws in word_slices(raw):
                    found = Counter(ws)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * len(found), pa.int64())), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["item_id", "term", "times"])

    rows = queries.where(F.col("item_id").isNotNull()).select("item_id", text_column(queries).alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term binary, times bigint").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def blocks_of(queries: DataFrame, most: int) -> Iterator[DataFrame]:
    """The queries in blocks of ``most`` terms at most, unless one bucket of queries (one sixteenth of a block, on the mean) has more."""
    parts = -(-16 * queries.count() // most)
    bucket, upto, start = F.pmod(F.xxhash64("item_id"), F.lit(parts)), 0, 0
    sizes = {r["b"]: r["count"] for r in queries.groupBy(bucket.alias("b")).count().collect()} if parts else {}
    for b in range(parts):
        if upto and upto + sizes.get(b, 0) > most:
            yield queries.where((bucket >= start) & (bucket < b))
            upto, start = 0, b
        upto += sizes.get(b, 0)
    if upto:
        yield queries.where(bucket >= start)


def searched(index: DataFrame, rows: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: each task's k best for every query of a block."""
    spark, kind = index.sparkSession, rows.schema["item_id"].dataType.simpleString()
    got = rows.toArrow().combine_chunks()
    terms = pc.unique(got["term"]).sort()
    items = pc.unique(got["item_id"])
    queries: list[list[tuple[int, int]]] = [[] for _ in range(len(items))]
    for i, t, n in zip(pc.index_in(got["item_id"], value_set=items).to_pylist(), pc.index_in(got["term"], value_set=terms).to_pylist(), got["times"].to_pylist()):
        queries[i].append((t, n))
    names = spark.sparkContext.broadcast(Block(terms, [], []))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(names.value.terms), np.int64)
        for batch in tidy(batches):
            for t, n in zip(batch.column(0), batch.column(1)):
                at, number = names.value.numbers(t.values)
                sums[number] += n.values.to_numpy()[at]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "df"])

    df = index.select("terms", "dfs").mapInArrow(held, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = [0] * len(terms)
    for t, n in zip(df["term"].to_pylist(), df["df"].to_pylist()):
        weights[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))
    block = spark.sparkContext.broadcast(Block(terms, queries, weights))
    names.unpersist()
    item_ids = items.to_pylist()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in block.value.queries]
        for batch in tidy(batches):
            for r in range(batch.num_rows):
                part = Shard({c: batch.column(c)[r] for c in ("ids", "sizes", "terms", "dfs", "ends", "postings")}, block.value, docs, total)
                if part.lists:
                    for query, heap in zip(block.value.queries, best):
                        walk(part, query, heap, k)
        for item, heap in enumerate(best):
            if heap:
                found = [None if -i == NAMELESS else -i for _, i in heap]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap)), pa.array(found, pa.int64()), pa.array([s for s, _ in heap])], ["item", "doc_id", "score"])

    found = index.select("ids", "sizes", "terms", "dfs", "ends", "postings").mapInArrow(search, "item bigint, doc_id bigint, score bigint")
    of = spark.createDataFrame(list(enumerate(item_ids)), f"item bigint, item_id {kind}")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(of), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as the block has queries


def search(docs: DataFrame, queries: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, **options) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores for each query."""
    index = materialise(build(docs, **options), "index")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked, out = materialise(query_terms(queries), "queries"), None
    for rows in blocks_of(asked, block_terms) if n else ():
        found = materialise(searched(index, rows, n, total, k), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return out
