"""Language identification by hierarchical discrimination.

First the language family, then, inside the family, one-versus-one linear support vector machines between its languages.
Every decision is linear in the frequencies of hashed byte n-grams of the whole text, so one pass over the bytes scores all
machines at once. Only the fit sees labels, on a bounded sample; the corpus itself is never shuffled or collected.

Defined cases: a null text, or one without any Unicode letter, is ``und`` with score 0. Rows without a language teach
nothing. With no usable training row every text is ``und``; with one language that language is predicted with score 1.
Repeated rows each get their own prediction. Very long texts are read in slices. Ties of votes and of probabilities go to the language
that is first in the alphabet. An empty table gives no rows. Extra columns are ignored by ``identify`` and kept by ``with_language``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import every_column, flat, remainder, runs, spare, tidy

#: Families of common languages by code. A language that is not listed forms a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fo", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la", "rm"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu", "or", "as", "sd", "si", "sa"],
    "iranian": ["fa", "ps", "ku", "ckb", "tg"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "sinitic": ["zh", "yue"],
    "semitic": ["ar", "he", "mt", "am", "ti"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk", "tt", "ug"],
    "austronesian": ["id", "ms", "jv", "su", "tl", "ceb", "mg", "mi"],
    "bantu": ["sw", "zu", "xh", "st", "sn", "rw", "ny"],
}
BITS = 13
ORDERS = (2, 3, 4)
#: Bytes of one text, and texts of one batch, whose n-grams are counted at a time.
SLICE, TEXTS = 1 << 19, 64
MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
#: ASCII letters in lower case, other ASCII as one space, bytes of other characters as they are.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def hashed(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the byte n-gram that starts at each position."""
    code = LETTERS[data].astype(np.uint32)
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        code = code[: len(data) - n + 1] | (LETTERS[data[n - 1 :]].astype(np.uint32) << np.uint32(8 * (n - 1)))
        if n in ORDERS:
            yield n, (code * np.uint32(MULTIPLIERS[n])) >> np.uint32(32 - BITS)


def slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """The text in parts of some SLICE bytes that overlap, so that each n-gram of four bytes starts in one part."""
    for at in range(0, max(len(data), 1), SLICE):
        yield data[at : at + SLICE + max(ORDERS) - 1]


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How often each n-gram bucket occurs in one text."""
    counts = np.zeros(1 << BITS)
    for k, part in enumerate(slices(data)):
        last = (k + 1) * SLICE >= len(data)
        for _, h in hashed(part):
            counts += np.bincount(h if last else h[:SLICE], minlength=1 << BITS)
    return counts


def frequencies(data: np.ndarray) -> np.ndarray:
    """Relative frequencies of the n-gram buckets of one text."""
    counts = bucket_counts(data)
    return counts / max(1.0, counts.sum())


def packed(vector: np.ndarray) -> bytes:
    """Positions (two bytes) and values (four bytes) of the entries other than 0."""
    at = np.flatnonzero(vector)
    return at.astype(np.uint16).tobytes() + vector[at].astype(np.float32).tobytes()


def linear_sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight over the n-grams of each text, for each machine: (texts, machines). N-grams that cross texts don't count."""
    n, size = len(offsets) - 1, 1 << BITS
    if n == 1:
        counts = bucket_counts(data)[None]
    else:
        counts, doc = np.zeros(n * size), np.repeat(np.arange(n) * size, np.diff(offsets))
        for order, h in hashed(data):
            at = np.arange(len(h)) + order <= np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
            counts += np.bincount(doc[: len(h)][at] + h[at], minlength=n * size)
        counts = counts.reshape(n, size)
    return counts @ weights.T.astype(float) / np.maximum(counts.sum(axis=1), 1)[:, None]


def svm(gram: np.ndarray, y: np.ndarray, c: float = 10.0, sweeps: int = 30) -> np.ndarray:
    """Dual coordinate descent for the squared-hinge linear machine; gives alpha * y."""
    n = len(y)
    alpha, f, diagonal = np.zeros(n), np.zeros(n), np.diag(gram) + 0.5 / c
    order = np.random.default_rng(0)
    for _ in range(sweeps):
        worst = 0.0
        for i in order.permutation(n):
            g = y[i] * f[i] - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diagonal[i])
            if new != alpha[i]:
                f += (new - alpha[i]) * y[i] * gram[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return alpha * y


@dataclass
class LanguageModel:
    """Families and machines: pairs of families, then pairs of languages of one family, each with weights and a bias."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # level ("" or the family), first, second
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and a score in 0..1 for each row of margins."""
        family, sure = self._vote("", sorted(self.families), margins)
        lang, score = np.empty(len(margins), object), np.zeros(len(margins))
        for f in self.families:
            at = family == f
            lang[at], inner = self._vote(f, sorted(self.families[f]), margins[at])
            score[at] = sure[at] * inner
        return lang, score

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-one votes; ties go to the larger sum of margins, then to the first name."""
        votes, sums, least = (np.zeros((len(margins), len(names))) for _ in range(3))
        least += 1
        for m, (at, a, b) in enumerate(self.pairs):
            if at == level:
                i, j = names.index(a), names.index(b)
                p = 1 / (1 + np.exp(-np.clip(2 * margins[:, m], -30, 30)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                sums[:, i] += p
                sums[:, j] += 1 - p
                least[:, i] = np.minimum(least[:, i], p)
                least[:, j] = np.minimum(least[:, j], 1 - p)
        best = np.argmax(votes + sums / (2 * len(names)), axis=1)
        return np.array(names, object)[best], least[np.arange(len(margins)), best]


def fit(rows: DataFrame, max_per_lang: int = 400, families: dict[str, list[str]] | None = None, max_rows: int = 6000) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of rows: at most ``max_per_lang`` different texts of each language and ``max_rows`` in all, chosen by a hash of the text."""
    of = {lang: name for name, langs in (families or FAMILIES).items() for lang in langs}
    rows = rows.select("text", "lang", F.xxhash64("text").alias("hash")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    tree: dict[str, list[str]] = {}
    for lang in sorted(counts):
        tree.setdefault(of.get(lang, lang), []).append(lang)
    model = LanguageModel(tree)
    if len(counts) < 2:
        return model
    most = max(1, min(max_per_lang, max_rows // len(counts)))
    draw = F.pmod("hash", F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1e6, 1.4e6 * most / n + 1))])

    @F.arrow_udf("binary")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            data, off = flat(batch)
            yield pa.array([packed(frequencies(data[off[i] : off[i + 1]])) for i in range(len(batch))], pa.binary())

    # Few more than ``most`` texts of a language get past the hash, copies count once, and only vectors of ``most`` reach the driver.
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).groupBy("lang", "draw", "hash").agg(F.min("text").alias("text"))
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "hash"))).where(F.col("at") <= most)
    got = drawn.select("lang", "at", vector.asNondeterministic()("text").alias("v")).toPandas().sort_values(["lang", "at"])
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for row, v in zip(x, got["v"]):
        at = np.frombuffer(v, np.uint16, len(v) // 6)
        row[at] = np.frombuffer(v, np.float32, offset=len(v) - 4 * len(at)) if len(at) else 0
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    lang = got["lang"].to_numpy()
    level = np.array([of.get(v, v) for v in lang])
    weights, bias = [], []
    jobs = [("", a, b, level) for a, b in itertools.combinations(sorted(tree), 2)]
    jobs += [(f, a, b, lang) for f in sorted(tree) for a, b in itertools.combinations(sorted(tree[f]), 2)]
    for at, a, b, key in jobs:
        use = np.flatnonzero((key == a) | (key == b))
        coef = svm((x[use] @ x[use].T + 1).astype(np.float64), np.where(key[use] == a, 1.0, -1.0))
        weights.append((coef @ x[use]) * scale)
        bias.append(coef.sum())
        model.pairs.append((at, a, b))
    model.weights, model.bias = np.array(weights, np.float32), np.array(bias)
    return model


def language(text: Column, model: LanguageModel) -> Column:
    """struct<lang_pred, score> of a text column."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            langs, scores = [], []
            data, off = flat(batch)
            for i, j in runs(off, SLICE, TEXTS):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                lang, score = model.decide(linear_sums(part, at, model.weights) + model.bias)
                langs += list(lang)
                scores += list(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.families:
        return none
    return F.when(text.rlike(r"\p{L}"), predict.asNondeterministic()(text)).otherwise(none)


def identify(docs: DataFrame, max_per_lang: int = 400, families: dict[str, list[str]] | None = None, max_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from documents that are not held out."""
    held = remainder("doc_id", 3) == 1
    model = fit(docs.where(F.coalesce(~held, F.lit(True))), max_per_lang, families, max_rows)
    got = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), language(F.col("text"), model).alias("r"))
    return got.select("doc_id", "held_out", "r.lang_pred", "r.score")


def keep_identified(docs: DataFrame, langs: list[str] | None = None, min_score: float = 0.0, into: str | None = None, **options) -> DataFrame:
    """The rows with a language (one of ``langs``, if given) of at least ``min_score``, with the same columns; the column ``into``, if given, holds the language found."""
    held = remainder("doc_id", 3) == 1
    model = fit(docs.where(F.coalesce(~held, F.lit(True))), **options)
    name = spare(docs, "__lang")
    got = docs.withColumn(name, language(F.col("text"), model))
    want = (F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= min_score)
    if langs is not None:
        want &= F.col(name)["lang_pred"].isin(langs)
    got = got.where(want)
    if into is not None:
        got = got.withColumn(into, F.col(name)["lang_pred"])
    return got.select(*every_column(docs))
