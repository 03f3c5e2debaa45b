"""Cross-entropy difference (Moore & Lewis 2010) between matched target and background bigram models.

Both models have the same order, smoothing and vocabulary: every word of the corpus, without limit (``vocab_size`` limits it on
request: the most frequent words, and classes by word ending for all others). The background counts every document, the target
all documents labelled good. Words go by 64-bit hashes, and so do the pairs that one task counts.

Counts of words form a distributed table. At most ``frequent`` words, the most frequent, are broadcast with their counts. Pairs
among the ``dense`` first of these are counted in tasks and scored from two broadcast tables of dense x dense numbers. All
other occurrences hold a rarer word and are dealt out by it, or by the pair if both words are frequent; a task then counts its
pairs, takes the rarer word's counts from the rows of the word table that were dealt out alike, and gives each occurrence's
losses. By the pigeonhole principle no such key has more than one in ``dense`` of all tokens, however skewed the corpus is. Pairs
of two rare words are dealt out by the second, and go on to the first word's counts by a join. Losses are summed by document.

Labels are joined to the ids of the documents in a shuffle. Up to ``MARKS`` good rows are broadcast as one bit a row; if there
are more, the flag is joined to the texts instead.

A document's score is the mean over its tokens of the target's loss minus the background's: below 0, it is more like the target.

Defined cases: null or wordless text has 0 tokens and null losses and score. Without labels the target is the smoothed uniform
model. Repeated rows count and are scored each. Very long texts are hashed in slices. Words of equal frequency rank by their hashes. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, flat, frequent_step, labelled_sample, materialise, numbered, runs, step_of, text_column, tidy, words
from .hashes import U, mix, word_hashes

START = 0  # the symbol before a text's first word
COUNTS = ["ub", "ut", "fb", "ft"]  # of a word: all its places, and those before another word, in background and target
WEIGHT, ADD = 0.7, 0.5
#: Good rows whose marks are broadcast; occurrences of rarer pairs that one task takes, about.
MARKS, PART_ROWS = 1 << 22, 2_000_000


@dataclass
class Vocabulary:
    """The frequent words; other words share classes by their last three bytes."""

    ids: dict[bytes, int]
    classes: int

    @property
    def size(self) -> int:
        return 1 + len(self.ids) + self.classes

    def name(self, word: bytes) -> bytes:
        return word if word in self.ids else b" %d" % (zlib.crc32(word[-3:]) % self.classes)


def word_counts(docs: DataFrame, flush: int = 200_000, flush_chars: int = 1 << 25) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in tidy(batches):
            for text in each(batch.column(0)):
                seen.update(words(text))
                size += len(text or "")
                if len(seen) >= flush or size >= flush_chars:
                    yield out()
                    seen.clear()
                    size = 0
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = 2048, classes: int = 256) -> Vocabulary:
    top = word_counts(docs).orderBy(F.desc("n"), "word").limit(size - classes - 1).collect()
    return Vocabulary({bytes(r["word"]): i for i, r in enumerate(top, 1)}, classes)


class Symbols(dict):
    """word -> 64-bit hash of its name in a limited vocabulary; emptied by ``encode`` when it is large."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        got = self[word] = int.from_bytes(hashlib.blake2b(self.vocab.name(word), digest_size=8).digest(), "little", signed=True) or 1
        return got

    def encode(self, text: str | None) -> np.ndarray:
        w = words(text)
        if len(self) > 100_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))


@dataclass
class Marks:
    """One bit a row, by the partition that it was numbered in: is its document in the target?"""

    bits: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> Marks:
        rows = np.sort(rows)
        parts, first = np.unique(rows >> 33, return_index=True)
        bits = {}
        for p, own in zip(parts.tolist(), np.split(rows & ((1 << 33) - 1), first[1:])):
            flags = np.zeros(int(own[-1]) + 1, bool)
            flags[own] = True
            bits[p] = np.packbits(flags)
        return cls(bits)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """1 for the rows that are marked."""
        part, at, out = rows >> 33, rows & ((1 << 33) - 1), np.zeros(len(rows), np.int64)
        for p in np.unique(part).tolist():
            held = self.bits.get(p)
            if held is not None:
                use = np.flatnonzero((part == p) & (at >> 3 < len(held)))
                out[use] = held[at[use] >> 3] >> (7 - (at[use] & 7)).astype(np.uint8) & 1
        return out


class Frequent:
    """The most frequent words: hash, rank and counts of each; symbol 0 has rank 0. Hashes are found by their leading bits."""

    BITS = 18

    def __init__(self, h: np.ndarray, counts: list[np.ndarray], dense: int):
        order = np.argsort(h.view(U))
        self.hashes, self.ranks, self.counts, self.dense = h[order], order, counts, dense
        lead = (self.hashes.view(U) >> U(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for rare ones."""
        at, out = self.first[(h.view(U) >> U(64 - self.BITS)).astype(np.int64)], np.full(len(h), -1, np.int64)
        for k in range(self.longest):
            here = np.minimum(at + k, len(self.hashes) - 1)
            out = np.where(self.hashes[here] == h, self.ranks[here], out)
        return out


def before(x: np.ndarray, at: np.ndarray, start) -> np.ndarray:
    """The word before each word, ``start`` where a text begins."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1][np.diff(at) > 0]] = start
    return out


def chunks(batches: Iterator[pa.RecordBatch], vocab: Vocabulary | None, marks, size: int = 1 << 19) -> Iterator[tuple]:
    """Of batches (any columns, row, text, good): some rows at a time, their target marks, the words of all, and the rows' offsets in these."""
    symbols = Symbols(vocab) if vocab else None
    for batch in tidy(batches):
        texts, rows = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 3).to_numpy(zero_copy_only=False)
        good = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64) if marks is None else marks.value(rows)
        data, off = flat(texts)
        for i, j in runs(off, size):
            if symbols is None:
                h, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h = h.view(np.int64)
                h = np.where(h == START, 1, h)
            else:
                got = [symbols.encode(t) for t in each(texts.slice(i, j - i))]
                h, at = np.concatenate(got), np.concatenate([[0], np.cumsum([len(g) for g in got])])
            yield batch.slice(i, j - i), good[i:j], h, at


def symbol_counts(docs: DataFrame, vocab: Vocabulary | None, marks, flush: int = 1 << 21) -> DataFrame:
    """w and its COUNTS. Symbol 0 stands before each text that has words."""

    def counted(all_words: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        """How often each of ``some`` (sorted) occurs."""
        got, n = np.unique(np.concatenate(all_words), return_counts=True) if all_words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = np.zeros(len(some), np.int64)
        out[np.searchsorted(some, got)] = n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])  # words and texts' last words, of all and of good rows
        size = starts = good_starts = 0

        def out() -> pa.RecordBatch:
            w = np.unique(np.concatenate(held[0])) if held[0] else np.zeros(0, np.int64)
            ub, ut, lb, lt = (counted(x, w) for x in held)
            cols = [np.append(c, n) for c, n in ((w, START), (ub, 0), (ut, 0), (ub - lb, starts), (ut - lt, good_starts))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w", *COUNTS])

        for _, good, h, at in chunks(batches, vocab, marks):
            n = np.diff(at)
            own, last = np.repeat(good, n) > 0, h[at[1:][n > 0] - 1]
            for kept, x in zip(held, (h, h[own], last, last[good[n > 0] > 0])):
                kept.append(x)
            starts, good_starts, size = starts + int((n > 0).sum()), good_starts + int(good[n > 0].sum()), size + len(h)
            if size >= flush:
                yield out()
                size = starts = good_starts = 0
                for kept in held:
                    kept.clear()
        yield out()

    got = docs.select("row", "text", "good").mapInArrow(run, "w bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return got.groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("ub > 0 or fb > 0")


def dense_counts(docs: DataFrame, vocab: Vocabulary | None, marks, top) -> DataFrame:
    """pair (first * dense + second), target, background of pairs of dense words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, held, size = top.value.dense, ([], []), 0
        sums = [np.zeros(d * d, np.int64) for _ in range(2)]

        def add() -> None:
            for total, kept in zip(sums, held):
                if kept:
                    total += np.bincount(np.concatenate(kept), minlength=d * d)
                kept.clear()

        for _, good, h, at in chunks(batches, vocab, marks):
            b = top.value.rank(h)
            a = before(b, at, 0)
            use = (a >= 0) & (a < d) & (b >= 0) & (b < d)
            pair = a[use] * d + b[use]
            held[0].append(pair[np.repeat(good, np.diff(at))[use] > 0])
            held[1].append(pair)
            size += len(pair)
            if size >= 1 << 21:
                add()
                size = 0
        add()
        pair = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(pair), *(pa.array(s[pair]) for s in sums)], ["pair", "target", "background"])

    parts = docs.select("row", "text", "good").mapInArrow(run, "pair bigint, target bigint, background bigint")
    return parts.groupBy("pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


#: Kinds of rows that are dealt out by k. Occurrences: the second word is rare, the first is, none is, both are; then the word
#: table: places of word k in background (other) and target, and those before another word.
SECOND, FIRST, NONE, BOTH, PLACES, FIRSTS = range(6)


def rarer_pairs(docs: DataFrame, vocab: Vocabulary | None, marks, top, both: bool) -> DataFrame:
    """Occurrences of pairs of two rare words, or else of other pairs that aren't dense: k, other, packed (row, kind, good).

    Rare words are hashes, frequent ones ranks; two ranks go into one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = top.value.dense
        for part, good, h, at in chunks(batches, vocab, marks):
            b = top.value.rank(h)
            a = before(b, at, 0)
            rare = (a < 0) & (b < 0)
            use = np.flatnonzero(rare if both else ~(rare | ((a >= 0) & (a < d) & (b >= 0) & (b < d))))
            packed = np.repeat(part.column(0).to_numpy(zero_copy_only=False) << 4 | good, np.diff(at))[use]
            first, second, a, b = before(h, at, START)[use], h[use], a[use], b[use]
            kind = np.where(a < 0, np.where(b < 0, BOTH, FIRST), np.where(b < 0, SECOND, NONE))
            k = np.where(kind == NONE, a << 20 | b, np.where(kind == FIRST, first, second))
            other = np.where(kind == BOTH, first, np.where(kind == FIRST, b, np.where(kind == SECOND, a, k)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k, other, packed | kind << 1)], ["k", "other", "packed"])

    return docs.select("row", "text", "good").mapInArrow(run, "k bigint, other bigint, packed bigint")


def chance(pair, first, single, total: float, size: int):
    """Interpolated bigram and add-constant unigram estimates, of numpy arrays."""
    uni = (single + ADD) / (total + ADD * size)
    return np.where(first > 0, WEIGHT * pair / np.maximum(first, 1) + (1 - WEIGHT) * uni, uni)


def loss(pair: Column, first: Column, single: Column, total: float, size: int) -> Column:
    """-log of ``chance``, of columns."""
    uni = (single + ADD) / (total + ADD * size)
    return -F.log(F.when(first > 0, WEIGHT * pair / first + (1 - WEIGHT) * uni).otherwise(uni))


def rarer_losses(dealt: DataFrame, top, totals: tuple[int, int], size: int, both: bool) -> DataFrame:
    """row, rt, rb of each occurrence; of pairs of two rare words row, k (the first), and the counts that the losses come from."""
    names = ["row", "k", "cb", "ct", "ub", "ut"] if both else ["row", "rt", "rb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in tidy(batches) if b.num_rows]  # a task's share, some PART_ROWS rows
        if not held:
            return
        k, other, packed = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(3))
        held.clear()
        kind = packed >> 1 & 7
        table = []  # hashes of rare words, and both counts
        for which in (PLACES, FIRSTS):
            at = np.flatnonzero(kind == which)
            at = at[np.argsort(k[at])]
            table.append((k[at], other[at], packed[at] >> 4))
        at = np.flatnonzero(kind < PLACES)
        k, other, packed, kind = k[at], other[at], packed[at], kind[at]
        if not len(k):
            return
        pair = mix(k.view(U) + mix((other << 3 | kind).view(U)))
        _, one, of = np.unique(pair, return_index=True, return_inverse=True)
        good, row = packed & 1, packed >> 4
        counts = np.bincount(of), np.bincount(of, good).astype(np.int64)
        k, other, kind = k[one], other[one], kind[one]  # from here one row for each pair

        def looked_up(which: int, model: int, use: np.ndarray) -> np.ndarray:
            keys, b, t = table[which]
            return (b, t)[model][np.searchsorted(keys, k[use])]

        if both:
            every = np.ones(len(k), bool)
            cols = [other, *counts, looked_up(0, 0, every), looked_up(0, 1, every)]
        else:
            cols, (s, r, n) = [], (kind == x for x in (SECOND, FIRST, NONE))
            for model in (1, 0):
                first, single = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                f, u = top.value.counts[2 + model], top.value.counts[model]
                first[s], single[s] = f[other[s]], looked_up(0, model, s)
                first[r], single[r] = looked_up(1, model, r), u[other[r]]
                first[n], single[n] = f[k[n] >> 20], u[k[n] & (1 << 20) - 1]
                cols.append(-np.log(chance(counts[model], first, single, totals[model], size)))
        for a in range(0, len(row), 1 << 18):
            part = of[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(row[a : a + (1 << 18)]), *(pa.array(c[part]) for c in cols)], names)

    return dealt.mapInArrow(run, "row bigint, " + ", ".join(f"{c} {'bigint' if both else 'double'}" for c in names[1:]))


def marked(docs: DataFrame, good: DataFrame) -> tuple[DataFrame, object]:
    """docs with a column good, and the broadcast marks that hold it instead if there are few enough."""
    rows = materialise(docs.select("doc_id", "row").join(good, "doc_id", "left_semi").select("row"), "good")
    if rows.count() <= MARKS:
        return docs.withColumn("good", F.lit(0)), docs.sparkSession.sparkContext.broadcast(Marks.of(rows.toArrow()["row"].to_numpy()))
    flags = rows.withColumn("good", F.lit(1))
    return materialise(docs.join(flags, "row", "left").select("doc_id", "row", "text", F.coalesce("good", F.lit(0)).alias("good")), "marked"), None


def score_documents(docs: DataFrame, labels: DataFrame, max_target: int | None = None, vocab_size: int | None = None, classes: int = 256, holdout: tuple[int, int] | None = (5, 0), frequent: int = 1 << 17, dense: int = 2048) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (their difference), each loss per token."""
    if not 1 <= dense <= frequent <= 1 << 20:
        raise ValueError("dense and frequent must be from 1 to 2^20, dense not the larger")
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    docs = numbered(docs.select("doc_id", text_column(docs).alias("text")), "row", "texts").select("doc_id", "row", "text")
    vocab = vocabulary(docs, vocab_size, classes) if vocab_size else None
    docs, marks = marked(docs, labelled_sample(labels.where(F.col("quality") == 1), "quality", max_target, holdout).select("doc_id"))

    table = materialise(symbol_counts(docs, vocab, marks), "symbols")
    real = table.where(F.col("w") != START)
    kinds, nb, nt = real.agg(F.count("*"), F.coalesce(F.sum("ub"), F.lit(0)), F.coalesce(F.sum("ut"), F.lit(0))).first()
    v = vocab.size if vocab else kinds + 1
    if not kinds:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), *[F.lit(None).cast("double").alias(c) for c in ("loss_target", "loss_background", "score")])
    cut = frequent_step(real, "ub", frequent - 1)
    head = pa.concat_tables([table.where(F.col("w") == START).toArrow(), real.where(step_of(F.col("ub")) >= cut).toArrow().sort_by([("ub", "descending"), ("w", "ascending")])])
    rest = real.where(step_of(F.col("ub")) < cut)
    h, counts = head["w"].to_numpy(), [head[c].to_numpy() for c in COUNTS]
    d = min(dense, len(h))
    top = send(Frequent(h, counts, d))

    got = dense_counts(docs, vocab, marks, top).toArrow()  # dense * dense rows at most
    pairs, tables, (ub, ut, fb, ft) = got["pair"].to_numpy(), [], counts
    for name, f, u, n in (("target", ft, ut, nt), ("background", fb, ub, nb)):
        c = np.zeros(d * d)
        c[pairs] = got[name].to_numpy()
        tables.append(-np.log(chance(c.reshape(d, d), f[:d, None], u[None, :d], n, v)).astype(np.float32))
    tables = send(tables)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, h, at in chunks(batches, vocab, marks):
            b, n = top.value.rank(h), np.diff(at)
            a = before(b, at, 0)
            use = np.flatnonzero((a >= 0) & (a < d) & (b >= 0) & (b < d))
            doc, a, b = np.repeat(np.arange(len(n)), n)[use], a[use], b[use]
            sums = [np.bincount(doc, t[a, b], len(n)).astype(float) for t in tables.value]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), *map(pa.array, sums)], ["doc_id", "row", "n_tokens", "rt", "rb"])

    scored = docs.mapInArrow(known, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, n_tokens bigint, rt double, rb double")

    words_of = lambda b, t, kind: rest.select(F.col("w").alias("k"), F.col(b).alias("other"), F.shiftleft(t, 4).bitwiseOR(F.lit(kind << 1)).alias("packed"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(nb - int(got["background"].to_numpy().sum()) + 2 * kinds) // PART_ROWS))
    dealt = rarer_pairs(docs, vocab, marks, top, False).unionByName(words_of("ub", "ut", PLACES)).unionByName(words_of("fb", "ft", FIRSTS))
    one = rarer_losses(dealt.repartition(parts, "k"), top, (nb, nt), v, False)
    dealt = rarer_pairs(docs, vocab, marks, top, True).unionByName(words_of("ub", "ut", PLACES))
    two = rarer_losses(dealt.repartition(parts, "k"), top, (nb, nt), v, True).join(rest.select(F.col("w").alias("k"), "fb", "ft"), "k")
    two = two.select("row", loss(F.col("ct"), F.col("ft"), F.col("ut"), nt, v).alias("rt"), loss(F.col("cb"), F.col("fb"), F.col("ub"), nb, v).alias("rb"))

    rows = scored.unionByName(one.unionByName(two), allowMissingColumns=True)
    rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("rt").alias("t"), F.sum("rb").alias("b"))
    mean = lambda x: F.when(F.col("n_tokens") > 0, F.col(x) / F.col("n_tokens"))
    rows = rows.select("doc_id", "n_tokens", mean("t").alias("loss_target"), mean("b").alias("loss_background"))
    return rows.withColumn("score", F.col("loss_target") - F.col("loss_background"))
