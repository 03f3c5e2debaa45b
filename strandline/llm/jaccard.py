"""Similarity join of texts by Jaccard similarity of word n-grams, with MinHash banding.

Texts of equal word sequences form a class; only one of each goes on. Signatures are cut into bands, as many and as long as the
target recall at the threshold asks for. Texts that share a band hash meet in a bucket, where signatures give a first
estimate; buckets are cut into blocks, so a large one is spread over many tasks, and each block gives a spanning forest of
its candidates, not its pairs. Texts whose candidates are connected then meet with their full n-gram sets, again in pairs
of bounded blocks, where every pair is verified exactly; a block gives each text's number of links and a spanning forest.
So every link counts and none is lost between texts that meet, but no step emits rows by the square of a group.

Exact link counts are the one thing here that costs the square of a group of similar, different texts: its blocks meet pairwise.
A block holds BLOCK_ROWS texts and BLOCK_GRAMS n-grams at most, so no task's work grows with the group, but their number does.

Defined cases: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a text of fewer than n words, but not
none, has one n-gram of all its words. Null and wordless texts link to nothing and stay. The class id is the smallest doc_id that
links lead to; a null id is larger than any other, so it names a class only if no row of it has an id. Rows are told apart by where
they stand, never by id: rows of one id with different texts are texts of their own, and rows with a null id take part like others.
Equal texts are links of similarity 1; n_links counts rows. Of repeated rows ``keep_one`` keeps one. An empty table gives no rows.
Extra columns are kept by ``keep_one`` only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, spread
from .common import every_column, flat, materialise, numbered, runs, spare, text_column, tidy
from .hashes import BASE, U, mix, powers, word_hashes

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Signatures of candidates agree in at least the threshold minus this many standard deviations.
SLACK = 5.0
#: Rows of a bucket in one block; texts and n-grams of candidates in one block.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_GRAMS = 512, 128, 1 << 17


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the longest rows with which a pair at the threshold shares a band with the chance ``recall``."""
    for rows in range(16, 0, -1):
        need = int(min(1e9, np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows)))))
        if need * rows <= most:
            return need, rows
    raise ValueError(f"{most} hashes don't reach a recall of {recall} at a similarity of {threshold}")


def grams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of the texts with their n+1 offsets, and the words' hashes with theirs."""
    w, at = word_hashes(data, off)
    counts = np.diff(at)
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    goff = np.concatenate([[0], np.cumsum(have)])
    pos = np.arange(goff[-1]) - np.repeat(goff[:-1], have) + np.repeat(at[:-1], have)
    length = np.repeat(np.minimum(counts, n), have)
    h = np.zeros(len(pos), U)
    for k in range(n):
        use = length > k
        h[use] = mix(h[use] + w[pos[use] + k] + U(k + 1))
    return h, goff, w, at


def signatures(h: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures (texts, size); texts without n-grams get zeros."""
    rng = np.random.default_rng(20240229)
    mult, add = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)
    out = np.zeros((len(off) - 1, size), np.uint32)
    some = np.flatnonzero(np.diff(off))
    if not len(some):
        return out
    x, starts = (h >> U(32)).astype(np.uint32), off[:-1][some]
    y = (h & U(0xFFFFFFFF)).astype(np.uint32)
    for k in range(size):
        v = x * mult[k] + add[k]
        v ^= y
        v *= np.uint32(0x9E3779B1)
        out[some, k] = np.minimum.reduceat(v, starts)
    return out


def sketch(docs: DataFrame, n: int, nb: int, nr: int) -> DataFrame:
    """row, doc_id, key (hashes of the word sequence; null if wordless), grams (how many), bands (hash of each), sig (a byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            data, off = flat(batch.column(2))
            for i, j in runs(off):
                h, goff, w, at = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                sig = signatures(h, goff, nb * nr)
                rows = sig.reshape(-1, nb, nr).astype(U)
                band = np.zeros(rows.shape[:2], U)
                for r in range(nr):
                    band = mix(band + rows[:, :, r] + U(r + 1))
                place = powers(BASE, len(w))
                place = mix(place + U(7))
                local = np.arange(len(w)) - np.repeat(at[:-1], np.diff(at))
                keys = []
                for salt in (0x1234567, 0x89ABCDEF):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(w + U(salt)) * place[local] if len(w) else w)])
                    keys.append(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U))
                raw = np.column_stack(keys).tobytes()
                some = np.diff(at) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], batch.column(1)[i:j], pa.array([raw[16 * d : 16 * d + 16] if ok else None for d, ok in enumerate(some)], pa.binary()), pa.array(np.diff(goff)),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * nb), pa.array(band.view(np.int64).ravel())),
                        pa.array([s.tobytes() for s in (sig >> np.uint32(24)).astype(np.uint8)], pa.binary()),
                    ],
                    ["row", "doc_id", "key", "grams", "bands", "sig"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, key binary, grams bigint, bands array<bigint>, sig binary")


class Forest:
    """Union of numbered nodes; the smallest number is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, others: np.ndarray) -> None:
        for b in np.unique(self.up[others]):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(a) for a in range(len(self.up))], np.int64)
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return at, roots[at]


def by_key(df: DataFrame, keys: list[str], work: Callable[[dict], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each key, one key at a time in each task: memory follows the largest key, not the task."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            out = work({n: t.column(n) for n in names})
            held.clear()
            if out is not None:
                yield out

        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            cols = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    yield from done()
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    # The number is given because work doesn't follow bytes: few small partitions, put together by size, would keep few cores busy.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def candidate_edges(reps: DataFrame, nb: int, nr: int, threshold: float) -> DataFrame:
    """a, b: spanning forests of the candidates in all buckets, by row."""
    size = nb * nr
    least = size * (threshold - SLACK * np.sqrt(threshold * (1 - threshold) / size))
    # Most texts share no bucket: only ids go to find those that do, and signatures then join these.
    keys = reps.select("row", F.posexplode("bands").alias("band", "hash")).select("row", F.xxhash64("band", "hash").alias("bucket"))
    full = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = spread(keys, full, "bucket", "row").join(reps.select("row", "sig"), "row")
    blocks = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.select("bucket", "row", "sig", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "sig")

    def work(c: dict) -> pa.RecordBatch | None:
        ids, own = c["row"].to_numpy(), c["own"].to_numpy()
        if len(ids) < 2:
            return None
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], own[order]
        sig = np.frombuffer(b"".join(c["sig"].to_pylist()), np.uint8).reshape(-1, size)[order]
        forest = Forest(len(ids))
        for k in range(len(ids) - 1):
            near = np.flatnonzero((sig[k + 1 :] == sig[k]).sum(axis=1) >= least) + k + 1
            forest.join(k, near) if len(near) else None
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(ids[b]), pa.array(ids[a])], ["a", "b"]) if len(a) else None

    return by_key(rows, ["bucket", "i", "j"], work, "a bigint, b bigint").distinct()


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """From row, copies, root, blocks, grams (sorted, distinct): rows (a, b, links): a's links in a block pair, or a forest edge (links 0)."""
    rows = sets.withColumn("own", F.pmod(F.xxhash64("row", F.lit(2)), F.col("blocks")).cast("int"))
    rows = rows.select("root", "row", "copies", "grams", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "copies", "grams")

    def work(c: dict) -> pa.RecordBatch | None:
        own, ids, copies = (c[n].to_numpy() for n in ("own", "row", "copies"))
        if len(ids) < 2:
            return None
        lists = c["grams"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        values, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        starts = np.concatenate([[0], np.cumsum(sizes)])
        code = np.concatenate([code[starts[k] : starts[k + 1]] for k in order])
        own, ids, copies, sizes = own[order], ids[order], copies[order], sizes[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark, links, forest = np.zeros(len(values), np.uint8), np.zeros(len(ids), np.int64), Forest(len(ids))
        same_block = c["i"][0] == c["j"][0]
        for k in range(len(ids) - 1):
            mine = code[starts[k] : starts[k + 1]]
            mark[mine] = 1
            rest = np.add.reduceat(mark[code[starts[k + 1] :]], starts[k + 1 : -1] - starts[k + 1], dtype=np.int64)
            mark[mine] = 0
            near = rest >= threshold * (sizes[k] + sizes[k + 1 :] - rest) - 1e-9
            if not same_block:
                near &= own[k + 1 :] != own[k]
            at = np.flatnonzero(near) + k + 1
            if len(at):
                links[k] += copies[at].sum()
                links[at] += copies[k]
                forest.join(k, at)
        a, b = forest.edges()
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[a]])), pa.array(np.concatenate([ids[some], ids[b]])), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))], ["a", "b", "links"])

    return by_key(rows, ["root", "i", "j"], work, "a bigint, b bigint, links bigint")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """row, copies, root, blocks, grams of rows with a text in the place of grams."""

    @F.arrow_udf("array<bigint>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            data, off = flat(batch)
            parts, ends = [], [0]
            for i, j in runs(off):
                h, goff, *_ = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                for d in range(j - i):
                    parts.append(np.unique(h[goff[d] : goff[d + 1]].view(np.int64)))
                    ends.append(ends[-1] + len(parts[-1]))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    return docs.select("row", "copies", "root", "blocks", sets.asNondeterministic()("text").alias("grams"))


def grouped(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """From row, doc_id, text: row, doc_id, least (the row that names the class: whether its id is null, id, row), n_links for every row."""
    spark = docs.sparkSession
    nb, nr = bands(threshold, recall)
    table = materialise(sketch(docs, n, nb, nr), "sketch")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = table.where("key is not null").groupBy("key").agg(F.min(order).alias("least"), F.count("*").alias("copies"), F.max("grams").alias("grams"))
    classes = materialise(classes.withColumn("row", F.col("least.row")), "classes")
    # One row stands for each class.
    reps = table.select("row", "bands", "sig").join(classes.select("row"), "row", "left_semi")
    near = materialise(components(spark, candidate_edges(reps, nb, nr, threshold)), "near")
    wanted = near.withColumnRenamed("node", "row").join(classes.select("row", "copies", "grams"), "row")
    enough = F.greatest(F.ceil(F.sum("grams") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    blocks = wanted.groupBy("root").agg(enough.alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    wanted = spread(wanted, blocks, "root", "row").select("row", "copies", "root", "blocks")
    found = materialise(verified(gram_sets(docs.select("row", "text").join(wanted, "row"), n), threshold), "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "row")
    groups = materialise(components(spark, found.where("links = 0").select("a", "b")).withColumnRenamed("node", "row"), "groups")
    names = groups.join(classes.select("row", "least"), "row").groupBy("root").agg(F.min("least").alias("first"))
    named = spread(groups, names, "root", "row").select("row", "first")
    of = classes.join(named, "row", "left").join(links, "row", "left")
    of = of.select("key", F.coalesce("first", "least").alias("least"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = table.select("row", "doc_id", "key")
    keyed = spread(rows.where("key is not null"), of, "key", "row").select("row", "doc_id", "least", "n_links")
    return keyed.unionByName(rows.where("key is null").select("row", "doc_id", order.alias("least"), F.lit(0).cast("bigint").alias("n_links")))


def link(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row."""
    rows = numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column(docs).alias("text")), "row", "texts")
    got = grouped(rows, n, threshold, recall)
    return got.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each group the row with the smallest id (then the first one), with the same columns."""
    name, other = spare(docs, "__row"), spare(docs, "__gone")
    rows = numbered(docs, name, "texts")
    gone = grouped(rows.select(F.col(name).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_column(rows).alias("text")), **options)
    gone = gone.where("row != least.row").select(F.col("row").alias(other))
    return rows.join(gone, rows[name] == gone[other], "left_anti").select(*every_column(docs))
