"""Toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

The log-odds of a word between toxic and other documents carry an informative Dirichlet prior (Monroe, Colaresi & Quinn
2008); a word without a significant difference takes that of its first five or four letters, so inflected and compound forms
count, and else scores a small constant below zero. A linear-time scan (Ruzzo & Tompa 1999) finds
all maximal segments of a text. Karlin-Altschul statistics turn segment scores into chances under the background
distribution, sums of the r best included, and a logistic curve fitted on the labelled sample turns the best of these into a
score in 0..1.

The fit uses a bounded sample of labelled rows (``max_rows``), one row for each id. The model keeps every word of the sample with a
significant and marked difference; if these were more than ``max_words``, which bounds the broadcast, the fit raises an error.
Scoring is one narrow pass over whole texts, and every maximal segment of a text counts.

Defined cases: null, empty or wordless text has no segment and the score of a text without evidence. Words not in the table
score the constant. If labels are missing or of one class only, every score is that class's (0 without labels).
Repeated rows are scored each. Very long texts are scored whole. An empty table gives no rows; a score of exactly 0.5 is predicted toxic, and no other ties
arise. Several labels of one id: the larger counts. Several rows of one id: the fit takes one of them, chosen by a hash of the text. Extra columns are kept by ``keep_civil`` only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, every_column, labelled_sample, materialise, remainder, spare, text_column, tidy

WORD = re.compile(r"[^\W\d_]+")
Segment = tuple[int, int, float]  # first word, word after the last, score


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def stems(word: str) -> list[str]:
    """The word, and its first five and four letters if it is longer, most specific first."""
    return [word, *(word[:k] + "*" for k in (5, 4) if len(word) > k)]


def maximal_segments(items: list[tuple[int, float]], gap: float) -> list[Segment]:
    """Ruzzo-Tompa over words at the given positions; every other word scores ``gap`` < 0. Linear in the number of items.

    Candidates keep the sums before and after them; a link to the nearest earlier candidate with a smaller sum before it
    replaces the backward search.
    """
    found: list[list] = []  # first, end, sum before, sum after, link
    total, position = 0.0, 0
    for at, score in items:
        total += gap * (at - position)
        position = at + 1
        before, total = total, total + score
        if score <= 0:
            continue
        new = [at, at + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


class Memo(dict):
    """Scores of words by their most specific entry; None for words without one. Emptied when it has grown."""

    def __init__(self, scores: dict[str, float], most: int = 200_000):
        self.scores, self.most = scores, most

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = next((s for stem in stems(word) if (s := self.scores.get(stem)) is not None), None)
        return found


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    gap: float = -0.5
    rate: float = 1.0  # Karlin-Altschul lambda
    k: float = 0.1
    slope: float = 0.0
    intercept: float = -50.0

    def segments(self, text: str | None, memo: Memo) -> tuple[int, list[Segment]]:
        """Number of words, and the maximal segments."""
        w = tokens(text)
        items = [(i, s) for i, s in enumerate(map(memo.__getitem__, w)) if s is not None]
        return len(w), maximal_segments(items, self.gap) if items else []

    def evidence(self, n: int, segments: list[Segment]) -> float:
        """Minus the log of the smallest chance, over r, of r segments of such a summed score in n background words."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted((s for *_, s in segments), reverse=True), 1):
            total += self.rate * s - math.log(max(1.0, self.k * n))
            if total <= 0:  # smaller segments can't bring it back above 0
                break
            best = max(best, total - (r - 1) * math.log(total + 1) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def chance(self, n: int, score: float) -> float:
        """Expected number of background segments of at least this score in n words."""
        return self.k * n * math.exp(-min(700.0, self.rate * score))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.intercept, -700, 700)))


def word_counts(rows: DataFrame, flush: int = 200_000, flush_chars: int = 1 << 25) -> DataFrame:
    """word, toxic, other: occurrences of words and stems in rows (text, y); each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        size = 0

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in (seen[1], seen[0]))], ["word", "toxic", "other"])

        for batch in tidy(batches):
            for text, y in zip(each(batch.column(0)), batch.column(1).to_pylist()):
                seen[1 if y else 0].update(s for w in tokens(text) for s in stems(w))
                size += len(text or "")
                if len(seen[0]) + len(seen[1]) >= flush or size >= flush_chars:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
                    size = 0
        yield out()

    parts = rows.select("text", "y").mapInArrow(run, "word string, toxic bigint, other bigint")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(counts: DataFrame, share: float) -> tuple[DataFrame, int, int, float]:
    """counts with ``delta`` and ``z`` under a Dirichlet prior that weighs ``share`` of all tokens, both totals, the weight."""
    t, o = counts.agg(F.sum("toxic"), F.sum("other")).first()
    t, o = t or 0, o or 0
    prior = share * (t + o)
    a = (F.col("toxic") + F.col("other")) * (prior / max(1, t + o))
    ft, fo = F.col("toxic") + a, F.col("other") + a
    delta = F.log(ft / (t + prior - ft)) - F.log(fo / (o + prior - fo))
    return counts.withColumn("delta", delta).withColumn("z", delta / F.sqrt(1 / ft + 1 / fo)), t, o, prior


def karlin_lambda(scores: np.ndarray, share: np.ndarray, gap: float) -> float:
    """The positive root of sum(share * exp(root * score)) + rest * exp(root * gap) = 1."""
    rest = max(0.0, 1 - share.sum())
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if (share * np.exp(np.clip(mid * scores, -700, 700))).sum() + rest * math.exp(mid * gap) > 1:
            hi = mid
        else:
            lo = mid
    return lo


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps."""
    scale = max(1e-9, np.abs(x).max())
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return w[0] / scale, w[1]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_words: int = 1 << 17, prior_share: float = 0.05, z_least: float = 3.0, delta_least: float = 2.0, gap: float = -0.5, holdout=(5, 0)) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled rows outside the holdout; the word table keeps significant, marked differences."""
    sample = labelled_sample(labels, "toxic", max_rows, holdout)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    rows = materialise(rows.select("text", "y"), "labelled")
    by_class = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = ToxicityModel(gap=gap)
    if not by_class.get(0) or not by_class.get(1):
        model.intercept = 50.0 if by_class.get(1) else -50.0
        return model
    odds, toxic, other, prior = log_odds(materialise(word_counts(rows), "words"), prior_share)
    found = odds.where((F.abs("z") >= z_least) & (F.abs("delta") >= delta_least) & (F.col("toxic") + F.col("other") >= 5))
    kept = found.limit(max_words + 1).collect()
    if len(kept) > max_words:
        raise ValueError(f"more than {max_words} words differ: raise z_least, delta_least or max_words")
    kept.sort(key=lambda r: r["word"])
    model.scores = {r["word"]: r["delta"] + gap for r in kept}
    if not any(s > 0 for s in model.scores.values()):
        model.intercept = math.log(by_class[1] / by_class[0])
        return model
    a = np.array([(r["toxic"] + r["other"]) * prior / (toxic + other) for r in kept])
    share = (np.array([r["other"] for r in kept]) + a) / (other + prior)
    model.rate = karlin_lambda(np.array([model.scores[r["word"]] for r in kept]), share, gap)

    got = rows.select("y", scored(F.col("text"), model)["evidence"].alias("x")).toPandas()  # two numbers a row of the bounded sample
    model.slope, model.intercept = logistic(np.log1p(got["x"].to_numpy()), got["y"].to_numpy(float))
    return model


SCORED = "struct<score: double, evidence: double, segments: array<struct<start: int, end: int, score: double, chance: double>>>"


def scored(text: Column, model: ToxicityModel, chance: float = 0.05) -> Column:
    """score, evidence, and the significant segments of a text column (positions in words)."""

    @F.arrow_udf(SCORED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(model.scores)
        for batch in tidy(batches):
            evidence, segments = [], []
            for text in each(batch):
                n, found = model.segments(text, memo)
                evidence.append(model.evidence(n, found) if found else 0.0)
                segments.append([{"start": a, "end": b, "score": s, "chance": e} for a, b, s in found if (e := model.chance(n, s)) <= chance])
            x = np.array(evidence, float)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())]))
            yield pa.StructArray.from_arrays([pa.array(model.probability(x)), pa.array(x), pa.array(segments, kind)], ["score", "evidence", "segments"])

    return run.asNondeterministic()(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant ``segments`` of every row."""
    model = fit(docs, labels, **options)
    got = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), scored(text_column(docs), model).alias("r"))
    return got.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.segments")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows that score below the threshold, with the same columns."""
    model, name = fit(docs, labels, **options), spare(docs, "__toxic")
    return docs.withColumn(name, scored(text_column(docs), model)).where(F.col(name)["score"] < threshold).select(*every_column(docs))
