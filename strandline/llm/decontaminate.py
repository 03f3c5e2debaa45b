"""Benchmark decontamination by Wu-Manber search over words.

The pattern alphabet is words. All windows of one length form one searcher: a shift table over blocks of two words says how
far the search may jump, a bucket keyed by the last block selects the windows that may end here, a prefix block rejects most
of those, and a direct comparison confirms the rest. Text that shares no word pair with any window is read at one word in
nine. Windows are made by Spark, one row for each item and window. If there are more than a block of them, they are dealt into blocks by
hash, so a window that very many items share is in many blocks; the
documents are searched for one block after the other, only one block's tables exist at a time, and what each pass finds is written
before the next begins. Findings are joined to the documents at the end.

Defined cases: null or wordless text has no words, no hits, is not contaminated and has the digest of the empty string.
Null or wordless items are never found. Equal windows of several items count for each item; repeated rows of one item count once.
Documents that repeat are each scored. Very long texts are searched whole, with a list of their words. An empty table gives no rows, and without items
nothing is found; no ties arise. ``contamination`` ignores extra columns, ``keep_clean`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each, every_column, materialise, numbered, spare, tidy, words

WINDOW = 10
#: Windows of items that one pass searches for (one that several items have counts for each), some 400 bytes each in a worker: about 40 MB.
BLOCK_WINDOWS = 100_000


def windows_of(text: str | None, width: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class Searcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.items = patterns
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[bytes, ...]]]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                key = b" ".join(p[end - b : end])
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(b" ".join(p[m - b :]), {}).setdefault(b" ".join(p[:b]), []).append(p)

    def find(self, w: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and pattern of every occurrence in the words."""
        m, b, shift, far = self.length, self.block, self.shift.get, self.length - self.block + 1
        end, n = m, len(w)
        while end <= n:
            key = w[end - 2] + b" " + w[end - 1] if b == 2 else w[end - 1]
            jump = shift(key, far)
            if jump:
                end += jump
                continue
            start = end - m
            for p in self.buckets[key].get(b" ".join(w[start : start + b]), ()):
                if tuple(w[start:end]) == p:
                    yield start, p
            end += 1


def searchers(patterns: dict[tuple[bytes, ...], list[str]]) -> list[Searcher]:
    by: dict[int, dict] = {}
    for p, ids in patterns.items():
        by.setdefault(len(p), {})[p] = ids
    return [Searcher(by[k]) for k in sorted(by)]


def patterns(benchmark: DataFrame, width: int) -> DataFrame:
    """item, pattern (the words of a window, joined by spaces): the windows of each item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at, text in enumerate(each(batch.column(1))):
                found = [b" ".join(p) for p in windows_of(text, width)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[at].as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "pattern"])

    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "item string, pattern binary").distinct()


def tables_of(spark: SparkSession, block: DataFrame) -> Broadcast:
    """The searchers of one block of patterns, broadcast."""
    got, found = block.select("pattern", "item").toArrow(), {}
    for p, item in zip(got["pattern"].to_pylist(), got["item"].to_pylist()):
        found.setdefault(tuple(p.split(b" ")), []).append(item)
    return spark.sparkContext.broadcast(searchers(found))


FOUND = "struct<n_words: bigint, starts: array<int>, ends: array<int>, items: array<string>>"


def finding(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    spans = merged(spans)
    return {"n_words": n_words, "starts": [a for a, _ in spans], "ends": [b for _, b in spans], "items": sorted(items)}


def findings(rows: list[dict]) -> pa.Array:
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))


def search(tables: Broadcast):
    """A function of text for one block of patterns."""

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidy(batches):
            rows = []
            for text in each(texts):
                w, spans, items = words(text), [], set()
                for s in tables.value:
                    for start, p in s.find(w):
                        spans.append((start, start + s.length))
                        items.update(s.items[p])
                rows.append(finding(len(w), spans, items))
            yield findings(rows)

    return run.asNondeterministic()


def together():
    """A function of text and the findings of all passes in it: one finding."""

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in tidy(batches):
            rows = []
            for text, found in zip(each(texts), lists):
                found = found.as_py() or []
                rows.append(finding(len(words(text)), [x for f in found for x in zip(f["starts"], f["ends"])], {x for f in found for x in f["items"]}))
            yield findings(rows)

    return run.asNondeterministic()


def found(docs: DataFrame, benchmark: DataFrame, name: str, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a column of this name: words, disjoint hit ranges [start, end) in words, and the sorted items with occurrences."""
    spark = docs.sparkSession
    table = materialise(patterns(benchmark, width), "patterns")
    blocks = -(-table.count() // block_windows)
    if blocks <= 1:
        return docs.withColumn(name, search(tables_of(spark, table))(F.col("text")))
    row, hits = spare(docs, "__row"), None
    docs = numbered(docs, row, "texts")
    for b in range(blocks):
        tables = tables_of(spark, table.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == b))
        one = docs.select(row, search(tables)(F.col("text")).alias("f")).where(F.size("f.starts") > 0)
        one = materialise(one, "hits")
        hits = one if hits is None else hits.unionByName(one)
        tables.destroy()
    hits = hits.groupBy(row).agg(F.collect_list("f").alias(name))  # a finding for each pass at most
    got = docs.join(hits, row, "left").drop(row)
    return got.withColumn(name, together()(F.col("text"), F.col(name)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit ranges as arrays ``starts`` and ``ends``."""
    got = found(docs.select("doc_id", "text"), benchmark, "__found", width, block_windows)
    hit = F.aggregate(F.zip_with("__found.ends", "__found.starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return got.select(
        "doc_id", F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("__found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "__found.items"), 256).alias("items_sha256"), (F.size("__found.starts") > 0).alias("contaminated"),
        F.col("__found.starts").alias("starts"), F.col("__found.ends").alias("ends"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any benchmark window, with the same columns."""
    name = spare(docs, "__found")
    return found(docs, benchmark, name, **options).where(F.size(F.col(name)["starts"]) == 0).select(*every_column(docs))
