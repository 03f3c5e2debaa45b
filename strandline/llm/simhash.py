"""Near duplicates by SimHash fingerprints (Charikar 2002), joined by deletion variants.

A fingerprint is cut into two segments. Of two fingerprints that differ in three bits at most, one segment differs in one bit at
most. So each segment is indexed as it is, and once for each of its bits with that bit left out; fingerprints that link meet
in an equality join of these variants, and the whole fingerprints are compared there. A variant that leaves a bit out is of use only
where both values of the bit occur, as segments that agree meet as they are.

Only distinct fingerprints are joined, so exact copies cost nothing. Variants are counted before any rows meet: most are held by one
fingerprint and go no further, and one held by two is a pair that the count itself names. A variant held by more than ``MOST``
fingerprints is cut again by the same rule: of the bits that it leaves open, two halves are indexed in turn, then halves of what those
leave open. Then at most 8 + 3 bits are open, so no group that is compared pair by pair is larger than 2,048, whatever the data; what
leaves a group is a spanning forest of its links, not its pairs.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null, empty and wordless texts have the fingerprint zero and
link to each other and to whatever lies near zero; a text of one or two words is one shingle. Long texts are read in slices. Ties
(a bit set in exactly half of the hashes) are 0. Rows of one id are each fingerprinted; the component's name is its smallest id,
and null only if no row of it has an id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, spread
from .common import discard, materialise, raw_texts, text_column, tidy, word_slices
from .jaccard import Forest, by_key

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of one variant that are compared pair by pair; more are cut again, down to no more than this.
MOST = 2048
#: Lower-cases A-Z and keeps everything but white space.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(raw: bytes, n: int = SHINGLE) -> int:
    """The 64 bits of a text as a signed number."""
    digest, total, count, tail = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []

    def add(digests: list[bytes]) -> int:
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        for a in range(0, len(bits), 255):
            total.__iadd__(np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8))
        return len(digests)

    for ws in word_slices(raw, SPACED):
        ws = tail + ws
        if len(ws) >= n:
            count += add([digest(b" ".join(s), SEED) for s in zip(*(ws[k:] for k in range(n)))])
        tail = ws[1 - n :] if n > 1 else []
    if not count and tail:
        count = add([digest(b" ".join(tail), SEED)])
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a bigint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in raw_texts(batch.column(1))], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def variants(rows: DataFrame, width: int) -> DataFrame:
    """From key, fp, rest (the bits that the key leaves open, ``width`` of them): key, fp, rest (now half as wide), side (the value of the bit left out)."""
    half = width // 2
    mask = (1 << half) - 1
    rows = rows.select("key", "fp", "rest", F.explode(F.sequence(F.lit(0), F.lit(2 * half + 1))).alias("v"))
    rows = rows.select("key", "fp", "rest", F.expr(f"v div {half + 1}").cast("int").alias("s"), F.expr(f"v % {half + 1}").cast("int").alias("bit"))
    segment = F.expr(f"shiftrightunsigned(rest, {half} * s)").bitwiseAND(F.lit(mask))
    rows = rows.select("key", "fp", "s", "bit", segment.alias("x"), F.expr(f"shiftrightunsigned(rest, {half} * (1 - s))").bitwiseAND(F.lit(mask)).alias("rest"))
    left = F.expr(f"if(bit < {half}, x & ~shiftleft(1L, bit), x)")
    return rows.select(F.xxhash64("key", "s", "bit", left).alias("key"), "fp", "rest", F.expr(f"if(bit < {half}, shiftrightunsigned(x, bit) & 1L, null)").alias("side"))


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """a, b: spanning forests of the pairs of fingerprints that differ in ``radius`` bits at most, from distinct ``fp``."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments find pairs of at most 3 differing bits")

    def near(c: dict) -> pa.RecordBatch | None:
        fp = np.unique(c["fp"].to_numpy())
        forest, bits = Forest(len(fp)), fp.view(np.uint64)
        for k in range(len(fp) - 1):
            at = np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= radius) + k + 1
            forest.join(k, at) if len(at) else None
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"]) if len(a) else None

    rows, found = fps.select(F.lit(0).cast("bigint").alias("key"), "fp", F.col("fp").alias("rest")), None
    for width in (64, 32, 16):
        wide = variants(rows, width)
        of = wide.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("side").alias("sides"), F.min("side").alias("low"), F.max("side").alias("high"))
        of = materialise(of.where((F.col("n") > 1) & ((F.col("sides") < F.col("n")) | (F.col("low") < F.col("high")))).select("key", "n", "a", "b"), "variants")
        few = F.col("n") <= most if width > 16 else F.lit(True)
        pairs = of.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
        grouped = by_key(wide.join(of.where((F.col("n") > 2) & few).select("key"), "key").select("key", "fp"), ["key"], near, "a bigint, b bigint")
        here = pairs.unionByName(grouped)
        found = here if found is None else found.unionByName(here)
        hot = of.where(~few).select("key")
        if width == 16 or not hot.limit(1).count():
            return found
        rows = materialise(spread(wide, hot, "key", "fp").select("key", "fp", "rest"), "hot")
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach) for every row."""
    rows = materialise(fingerprints(docs), "simhash")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    near = components(docs.sparkSession, links(fps.select("fp"), radius, most))
    near = near.withColumnRenamed("node", "fp")
    first = near.join(fps, "fp").groupBy("root").agg(F.min("least").alias("first"))
    named = materialise(fps.join(spread(near, first, "root", "fp").select("fp", "first"), "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id")), "named")
    discard(fps)
    got = spread(rows, named, "fp", "doc_id")
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
