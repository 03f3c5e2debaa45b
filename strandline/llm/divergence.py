"""Divergence of the sources of a language from each other, by an inverted index of corrections to a baseline.

Each source gives each term that its language keeps a smoothed whole-number chance p, and two chances p, q differ by
f = (p - q)^2 div (p + q). A pair of sources starts at V times the f of two zero counts, V being the number of kept terms: that is its value
if neither held any term. Postings (term, source, count) then emit corrections, all nonzero: what a term of one source changes against a
zero count of the other, and for terms of both what the two changes together differ from that. The first kind depends on the chance alone, so a source's
terms are put together by chance before they meet the other sources; the second comes from a join of postings by term. Sums of the
corrections and the baseline are whole numbers, so the result is exact and the same in any order.

Counts are made in the tasks that read the texts and are added up by (lang, source, term). Postings of a term are cut into blocks of some
``BLOCK`` sources that meet in pairs, so a term of very many sources is many tasks. A source's best terms are ranked by a window, whose limit
Spark applies before it shuffles.

Defined cases: null text, lang and source count as ''. Rows that repeat an id are documents of their own. A language with fewer than ``least``
documents keeps no term: its pairs have value 0 and its sources no terms. A language with one source has no pairs, and no term
stands out in it. Long texts are read in slices. Equal values rank by UTF-8 of the item. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import spread
from .common import materialise, raw_texts, text_column, tidy, word_slices

LEAST, TOP = 10, 10
#: Sources of a term that meet in one block; terms that a task holds before it gives them on.
BLOCK, HELD = 256, 300_000
#: Lower-cases A-Z and keeps a-z and every byte of a non-ASCII character.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a null term for each group that occurs."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                keys, size = [None, *terms.keys()], len(terms) + 1
                held = docs[lang, source]
                cols = [pa.array([lang] * size), pa.array([source] * size), pa.array(keys, pa.binary()).cast(pa.string()), pa.array([0, *terms.values()], pa.int64()), pa.array([0, *(held[t] for t in terms)], pa.int64())]
                whole = pa.RecordBatch.from_arrays(cols, names)
                yield from (whole.slice(a, 1 << 15) for a in range(0, size, 1 << 15))
            n.clear()
            docs.clear()

        size = 0
        for batch in tidy(batches):
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                counts, held = n[lang, source], docs[lang, source]
                size -= len(counts)
                seen: set[bytes] = set()
                for ws in word_slices(raw, LETTERS):
                    counts.update(ws)
                    seen.update(ws)
                held.update(seen)
                size += len(counts)
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), text_column(docs).alias("text"))
    rows = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(n: str, total: str, v: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)); null without terms. In decimals, as the product leaves 64 bits beyond 9 * 10^9 occurrences."""
    return F.expr(f"1L + (cast({UNIT} as decimal(10, 0)) * cast({n} + 2L as decimal(19, 0))) div cast(nullif({total} + 2L * {v}, 0L) as decimal(19, 0))")


def f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def kept_postings(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Postings lang, source, term, p, p0 (of a zero count), q (the language's), blocks; and groups lang, source, v, p0."""
    terms = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least)
    terms = materialise(terms.select("lang", "term", "all"), "terms")
    kept = materialise(counts.where(F.col("term").isNotNull()).join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(sums, ["lang", "source"], "left").join(sources.join(langs, "lang", "left"), "lang")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total", "blocks")
    groups = materialise(groups.withColumn("p0", chance("0L", "total", "v")), "groups")
    postings = spread(kept, groups, ["lang", "source"], "term")
    postings = postings.select("lang", "source", "term", chance("n", "total", "v").alias("p"), "p0", chance("all", "lang_total", "v").alias("q"), "blocks")
    return materialise(postings, "postings"), groups


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value of every pair a < b of a language's sources."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    pair = [F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    base = spread(groups, other, "lang", "source").where("source < other").select("lang", *pair, F.expr(f"if(v = 0, 0L, v * {f('p0', 'q0')})").alias("value"))
    # Terms of one source against a zero count of the other.
    like = postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    one = spread(like, other, "lang", ["source", "p"]).where("source <> other")
    one = one.select("lang", *pair, F.expr(f"m * ({f('p', 'q0')} - {f('p0', 'q0')})").alias("value"))
    # Terms of both: what is left after both have been taken against zero counts.
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    dealt = postings.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "term", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "source", "p", "p0")
    right = dealt.select("lang", "term", "i", "j", F.col("own").alias("other_own"), F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    two = dealt.join(right, ["lang", "term", "i", "j"]).where("source < other and (i = j or own <> other_own)")
    two = two.select("lang", *pair, F.expr(f"{f('p', 'q')} - {f('p', 'q0')} - {f('p0', 'q')} + {f('p0', 'q0')}").alias("value"))
    return base.unionByName(one).unionByName(two).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by distance (``pair``), and the terms that stand out (``term``)."""
    counts = materialise(term_counts(docs), "counts")
    postings, groups = kept_postings(counts, least)
    pairs = pair_values(postings, groups)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    pairs = pairs.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
