"""Token ids in a binary file format with a shared zstandard dictionary.

Each document is one zstandard frame over its serialized ids, compressed with a dictionary that was trained on a bounded
sample of such arrays. A shard holds the frames of consecutive documents back to back, with their offsets, token counts and
ids, the least and largest id, and the SHA-256 of the dictionary. Shards are rows of a Parquet folder, so Spark's committer makes
writing atomic on any store; row groups are small, so a look-up by id skips all but the few whose range holds it, reads the index
columns of these, and then the frames of the shards with a hit. The dictionary is a one-row table beside them.

The dictionary is trained on at most 1,000 texts, drawn by a hash, and at most 8 KiB of the ids of each. The same table gives the same files.

Defined cases: a null or empty text is the end id alone. Documents stand in ascending doc_id order, null first; rows with
equal ids stand in order of a digest of their ids, and where they are many, in several partitions. Very long texts are encoded whole; a document is one frame in one shard.
An empty table gives an empty folder of shards. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import each, shared_path, tidy

SHARD = "part int, shard int, before bigint, dict_sha256 string, least bigint, largest bigint, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, frames binary"
#: Bytes of frames in one shard, about.
SHARD_BYTES = 4 << 20


def train_dictionary(docs: DataFrame, path: str, samples: int = 1000, size: int = 64 << 10, sample_bytes: int = 8 << 10) -> bytes:
    """A dictionary from the serialized ids of at most ``samples`` documents, the same for the same texts; empty if there are too few to train on.

    Texts are drawn by a hash. Of one with more than ``sample_bytes`` of ids, a stretch of that length is taken, from a place that a hash of it says.
    """
    import zstandard

    rows = docs.select("text").where(F.length("text") > 0)
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1e6, 1.2e6 * samples / max(1, n)))).dropDuplicates(["text"]).orderBy(F.xxhash64("text"), F.length("text"), "text").limit(samples)  # copies of a text are drawn together

    @F.arrow_udf("binary")
    def serialized(texts: pa.Array) -> pa.Array:
        return pa.array([stretch(ids, sample_bytes) for ids in encoder(path).encode(each(texts))], pa.binary())

    got = [bytes(r[0]) for r in drawn.select(serialized.asNondeterministic()("text")).collect()]
    try:
        return zstandard.train_dictionary(size, got).as_bytes() if len(got) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def stretch(ids: bytes, size: int) -> bytes:
    """One of the consecutive stretches of this size, chosen by a checksum."""
    at = zlib.crc32(ids) % -(-len(ids) // size) * size if ids else 0
    return ids[at : at + size]


def place(cuts: list[int], nameless: int, doc: int | None, digest: bytes) -> int:
    """The partition of a document: by the sorted cuts after those for documents without an id. An id that several cuts name has as many partitions, by digest."""
    share = int.from_bytes(digest[:4], "big")
    if doc is None:
        return share * nameless >> 32
    first, after = bisect.bisect_left(cuts, doc), bisect.bisect_right(cuts, doc)
    return nameless + first + ((1 + (share * (after - first) >> 32)) if after > first else 0)


def codec(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_tokens(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None, level: int = 3) -> str:
    """Write shards and dictionary under ``folder``; gives the folder."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, with_id = rows.agg(F.count("*"), F.count("doc_id")).first()
    cuts = sorted(int(c) for c in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)) if parts > 1 else []
    nameless = -(-parts * (n - with_id) // n) if n else 0

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = encoder(path), zstandard.ZstdCompressor(level=level, **codec(dictionary))
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in tidy(batches):
            frames, sizes, digests = [], [], []
            for ids in enc.encode(each(batch.column(1))):
                digests.append(hashlib.blake2b(ids, digest_size=16).digest())
                frames.append(pack.compress(ids + end))
                sizes.append((len(ids) + len(end)) // enc.dtype.itemsize)
            part = [place(cuts, nameless, d, digest) for d, digest in zip(batch.column(0).to_pylist(), digests)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "part", "digest", "n", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, frames, offsets = [], [], [], [0]

        def shard() -> pa.RecordBatch:
            row = {"part": part, "shard": number, "before": before, "dict_sha256": digest, "least": next((d for d in ids if d is not None), None), "largest": ids[-1], "doc_ids": ids, "n_tokens": sizes, "offsets": offsets, "frames": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("dict_sha256", pa.string()), ("least", pa.int64()), ("largest", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())]))

        for batch in tidy(batches):
            for doc, n, frame in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(doc)
                sizes.append(n)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                if offsets[-1] >= SHARD_BYTES:
                    yield shard()
                    number, before = number + 1, before + sum(sizes)
                    ids, sizes, frames, offsets = [], [], [], [0]
        if ids:
            yield shard()

    framed = rows.mapInArrow(compress, "doc_id bigint, part int, digest binary, n bigint, frame binary")
    ordered = framed.repartitionById(nameless + len(cuts) + 1, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest")
    ordered.select("doc_id", "n", "frame").mapInArrow(shards, SHARD).write.option("compression", "none").option("parquet.block.size", SHARD_BYTES).parquet(f"{folder}/shards")
    return folder


def dictionary_of(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    found = bytes(row["dictionary"])
    if hashlib.sha256(found).hexdigest() != row["dict_sha256"]:
        raise ValueError(f"the dictionary in {folder} doesn't have the hash that stands beside it")
    return row["dict_sha256"], found


def unpack(frame: bytes, reader, wide: bool) -> np.ndarray:
    return np.frombuffer(reader.decompress(frame), "<u4" if wide else "<u2").astype("<u4")


def read_tokens(spark: SparkSession, folder: str, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document from the files, and its ids if asked for."""
    digest, dictionary = dictionary_of(spark, folder)
    wide = encoder(path or tokenizer_path()).dtype.itemsize == 4
    shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")
    last = shards.select("part", (F.col("before") + F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("upto")).groupBy("part").agg(F.max("upto").alias("upto"))
    first, total = {}, 0
    for r in sorted(last.collect()):  # one row for each of the writer's partitions
        first[r["part"]] = total
        total += r["upto"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader = zstandard.ZstdDecompressor(**codec(dictionary))
        for batch in tidy(batches):
            for s in range(batch.num_rows):
                part, _, before, sha, _, _, ids, sizes, offsets, frames = (batch.column(c)[s].as_py() for c in range(10))
                if sha != digest:
                    raise ValueError("the shard was written with another dictionary")
                start, out = first[part] + before, []
                for k, doc in enumerate(ids):
                    got = unpack(frames[offsets[k] : offsets[k + 1]], reader, wide)
                    if len(got) != sizes[k]:
                        raise ValueError("the token count of a frame differs from the index")
                    out.append({"doc_id": doc, "start": start, "n_tokens": len(got), "ids_crc32": zlib.crc32(got.tobytes())} | ({"ids": got.tolist()} if with_ids else {}))
                    start += len(got)
                kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds + [("ids", pa.list_(pa.int64()))] * with_ids))

    return shards.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def holding(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """part, shard, and start and stop of the frames of the documents with this id, from the index columns of the shards in whose range it lies."""
    at = F.posexplode("doc_ids").alias("k", "id")
    near = spark.read.schema(SHARD).parquet(f"{folder}/shards").where((F.col("least") <= doc_id) & (F.col("largest") >= doc_id))
    hits = near.select("part", "shard", "offsets", at).where(F.col("id") == doc_id)
    return hits.select("part", "shard", F.element_at("offsets", F.col("k") + 1).alias("start"), F.element_at("offsets", F.col("k") + 2).alias("stop"))


def fetch(spark: SparkSession, folder: str, doc_id: int, path: str | None = None) -> list[list[int]]:
    """The ids of the documents with this id: one frame is decompressed for each, found by the shard's index."""
    import zstandard

    wide = encoder(path or tokenizer_path()).dtype.itemsize == 4
    reader = zstandard.ZstdDecompressor(**codec(dictionary_of(spark, folder)[1]))
    found = []
    for r in holding(spark, folder, doc_id).orderBy("part", "shard", "start").collect():
        one = spark.read.schema(SHARD).parquet(f"{folder}/shards").where((F.col("part") == r["part"]) & (F.col("shard") == r["shard"]) & (F.col("least") <= doc_id) & (F.col("largest") >= doc_id))
        found += [bytes(x[0]) for x in one.select(F.substring(F.col("frames"), F.lit(r["start"] + 1), F.lit(r["stop"] - r["start"]))).collect()]
    return [unpack(f, reader, wide).tolist() for f in found]


def encode_and_read(docs: DataFrame, end_id: int = 2, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the files in the shared folder (or ``folder``) and read them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or shared_path(spark, "tokens"), end_id, path), path)
