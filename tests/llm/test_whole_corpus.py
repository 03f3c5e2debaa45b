"""LM scores count every word as itself and every good document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import lmscore, queries

from .test_operators import plain_words


def plain_scores(texts, good):
    """doc_id: n_tokens, score, by plain counts of all words and pairs."""
    words = {d: plain_words(t) for d, t in texts.items()}
    size = 1 + len({w for ws in words.values() for w in ws})

    def model(which):
        pairs, first, single = Counter(), Counter(), Counter()
        for d in which:
            for a, b in zip([None, *words[d]], words[d]):
                pairs[a, b] += 1
                first[a] += 1
                single[b] += 1
        total = sum(single.values())
        uni = lambda b: (single[b] + 0.5) / (total + 0.5 * size)
        return lambda a, b: -math.log(0.7 * pairs[a, b] / first[a] + 0.3 * uni(b) if first[a] else uni(b))

    t, b = model([d for d in words if d in good]), model(words)
    return {d: (len(ws), np.mean([t(*p) - b(*p) for p in zip([None, *ws], ws)]) if ws else None) for d, ws in words.items()}


def corpus(n, kinds):
    rng = random.Random(5)
    return {d: " ".join(f"w{int(rng.paretovariate(0.7)) % kinds}" for _ in range(rng.randrange(0, 60))) for d in range(n)}


@pytest.mark.parametrize("frequent, dense", [(1 << 17, 2048), (1 << 17, 5), (30, 5), (1, 1)])
def test_every_word_and_good_document_counts(spark, frequent, dense):
    texts = corpus(150, 4000)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(d, int(d % 3 == 0), 0) for d in texts], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in lmscore.score_documents(docs, labels, holdout=None, frequent=frequent, dense=dense).collect()}
    want = plain_scores(texts, {d for d in texts if d % 3 == 0})
    assert set(got) == set(want)
    for d, (n, score) in want.items():
        assert got[d]["n_tokens"] == n and got[d]["score"] == (score if score is None else pytest.approx(score, abs=1e-4))


def test_query_has_more_words_than_the_dense_table_and_no_holdout(spark, tmp_path):
    rng = random.Random(6)
    texts = {d: " ".join(f"v{rng.randrange(6000)}" for _ in range(200)) for d in range(60)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op8_lm_scoring(spark, str(tmp_path)).collect()}
    for d, (_, score) in plain_scores(texts, {d for d in texts if d % 2}).items():
        assert got[d] == pytest.approx(score, abs=1e-4)


def test_target_has_no_limit(spark):
    rows = 25_000
    docs = spark.range(rows).selectExpr("id AS doc_id", "'good' AS text")
    labels = spark.range(rows).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    got = lmscore.score_documents(docs, labels, holdout=None)
    assert got.count() == rows and got.where("abs(score) > 1e-9").count() == 0  # the target is the background


def test_more_marks_than_the_bound_are_joined(spark, monkeypatch):
    texts = corpus(60, 300)
    docs = spark.createDataFrame([*texts.items(), (None, "w1 w2 w1")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in texts], "doc_id bigint, quality int, toxic int")
    few, many = [], []
    for bound, out in ((1 << 22, few), (3, many)):
        monkeypatch.setattr(lmscore, "MARKS", bound)
        out += lmscore.score_documents(docs, labels, holdout=None).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])
    for a, b in zip(sorted(few, key=key), sorted(many, key=key), strict=True):
        assert a["doc_id"] == b["doc_id"] and (a["score"] is None or a["score"] == pytest.approx(b["score"], abs=1e-9))
