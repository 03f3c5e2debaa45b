"""The registered queries over whole tables against plain Python: models are fitted again from their definitions, or held to what defines them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import bpe, hashes, langid
from strandline.llm.common import words
from strandline.llm.queries import QUERIES

from ..oracle import SF
from .test_operators import brute_segments, check_packing, table
from .test_whole_corpus import plain_scores


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in table(spark, "documents").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in table(spark, "labels").collect()}


def plain_grams(text):
    """Buckets of the byte n-grams of a text, one by one."""
    b = bytes(int(langid.LETTERS[x]) for x in (text or "").encode())
    out = Counter()
    for n, mult in langid.MULTIPLIERS.items():
        for i in range(len(b) - n + 1):
            out[(int.from_bytes(b[i : i + n], "little") * mult & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
    return out


def test_language_id(spark, documents):
    docs = table(spark, "documents")
    model = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    assert set(got) == set(documents)

    def vote(level, names, margin):
        if len(names) == 1:
            return names[0], 1.0
        p = {}
        for (at, a, b), m in zip(model.pairs, margin):
            if at == level:
                p[a, b] = 1 / (1 + math.exp(-2 * m))
                p[b, a] = 1 - p[a, b]
        value = {n: sum(p[n, o] >= 0.5 for o in names if o != n) + sum(p[n, o] for o in names if o != n) / (2 * len(names)) for n in names}
        best = max(names, key=lambda n: value[n])
        return best, min(p[best, o] for o in names if o != best)

    for d in list(documents)[::4]:
        text = documents[d]["text"]
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        g = plain_grams(text)
        total = max(1, sum(g.values()))
        margin = [sum(float(w[k]) * n for k, n in g.items()) / total + b for w, b in zip(model.weights, model.bias)]
        family, sure = vote("", sorted(model.families), margin)
        lang, inner = vote(family, sorted(model.families[family]), margin)
        assert got[d]["lang_pred"] == lang and got[d]["score"] == pytest.approx(sure * inner, abs=1e-4)


def test_machines_are_at_their_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((80, 5)), np.where(rng.random(80) < 0.5, 1.0, -1.0)
    c = 10.0
    gram = x @ x.T + 1
    a = langid.svm(gram, y, c, sweeps=2000)
    alpha, margin = a * y, y * (gram @ a)
    assert (alpha >= 0).all()  # and complementary slackness of the squared hinge
    assert np.allclose(margin[alpha > 0], 1 - alpha[alpha > 0] / (2 * c), atol=0.02) and (margin[alpha == 0] > 1 - 0.02).all()


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = ("Ünï ab " + "x" * 300 + " cd ") * 20
    data = np.frombuffer(text.encode(), np.uint8)
    whole, _ = hashes.word_hashes(data, np.array([0, len(data)]))
    counts = langid.bucket_counts(data)
    assert {k: v for k, v in enumerate(counts) if v} == plain_grams(text) and len(set(whole.tolist())) == len(set(words(text)))
    for size in (5, 64, 1000):
        monkeypatch.setattr(hashes, "SLICE", size)
        monkeypatch.setattr(langid, "SLICE", size)
        assert (hashes.word_hashes(data, np.array([0, len(data)]))[0] == whole).all() and (langid.bucket_counts(data) == counts).all()


def plain_toxicity(documents, labels):
    """The whole operator in plain Python: counts, log-odds, segments, calibration and score."""
    word = re.compile(r"[^\W\d_]+")
    stems = lambda w: [w, *(w[:k] + "*" for k in (5, 4) if len(w) > k)]
    tokens = {d: word.findall((r["text"] or "").lower()) for d, r in documents.items()}
    train = {d: int(r["toxic"]) for d, r in labels.items() if r["toxic"] is not None and d in documents and zlib.crc32(str(d).encode()) % 5 != 0}
    counts = (Counter(), Counter())
    for d, y in train.items():
        counts[y].update(s for w in tokens[d] for s in stems(w))
    o, t = sum(counts[0].values()), sum(counts[1].values())
    prior, gap, scores, share = 0.05 * (t + o), -0.5, {}, {}
    for w in counts[0].keys() | counts[1].keys():
        n0, n1 = counts[0][w], counts[1][w]
        a = (n0 + n1) * prior / (t + o)
        delta = math.log((n1 + a) / (t + prior - n1 - a)) - math.log((n0 + a) / (o + prior - n0 - a))
        if n0 + n1 >= 5 and abs(delta) >= 2 and abs(delta / math.sqrt(1 / (n1 + a) + 1 / (n0 + a))) >= 3:
            scores[w], share[w] = delta + gap, (n0 + a) / (o + prior)
    rest = max(0.0, 1 - sum(share.values()))
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(share[w] * math.exp(min(700, mid * scores[w])) for w in scores) + rest * math.exp(mid * gap) > 1 else (mid, hi)

    def evidence(w):
        values = [next((scores[s] for s in stems(x) if s in scores), gap) for x in w]
        parts = sorted((s for *_, s in (brute_segments(values) if len(w) <= 60 else quick_segments(values))), reverse=True)
        best = total = 0.0
        for r, s in enumerate(parts, 1):
            total += lo * s - math.log(max(1.0, 0.1 * len(w)))
            if total > 0:
                best = max(best, total - (r - 1) * math.log(total + 1) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    found = {d: evidence(w) for d, w in tokens.items()}
    x, y = np.array([math.log1p(found[d]) for d in train]), np.array(list(train.values()), float)
    scale = max(1e-9, np.abs(x).max())
    z, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, z.T @ (p - y) + 1e-3 * w), -5, 5)
    return {d: 1 / (1 + math.exp(-(w[0] / scale * math.log1p(e) + w[1]))) for d, e in found.items()}


def quick_segments(values):
    """All maximal segments as Ruzzo and Tompa state them, with the plain backward search."""
    found, total = [], 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = next((j for j in range(len(found) - 1, -1, -1) if found[j][2] < new[2]), None)
            if j is None or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - start) for a, b, start, after in found]


def test_toxicity(spark, documents, labels):
    want = plain_toxicity(documents, labels)
    got = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    assert set(got) == set(want)
    for d, p in want.items():
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["score"] == pytest.approx(p, abs=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_fit_takes_one_row_of_each_id(spark, labels):
    from pyspark.sql import functions as F

    from strandline.llm import toxicity

    docs = table(spark, "documents")
    thrice = docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit(None).cast("string")))
    seen = []
    counted = toxicity.word_counts
    try:
        toxicity.word_counts = lambda rows: seen.append(rows.count()) or counted(rows)
        toxicity.fit(thrice, table(spark, "labels"), max_rows=40)
    finally:
        toxicity.word_counts = counted
    assert seen == [40]


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    rows = QUERIES["op3_packing"](spark, SF).collect()
    bins = check_packing(rows, [(d, r["text"]) for d, r in documents.items()], tokenizer, 2048, 0)
    assert bins <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(bpe.tokenizer_path()), 0
    got = sorted(QUERIES["op6_token_files"](spark, SF).collect())
    assert [r["doc_id"] for r in got] == sorted(documents)
    for r in got:
        ids = np.array(tokenizer.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_lm_scores(spark, documents, labels):
    want = plain_scores({d: r["text"] for d, r in documents.items()}, {d for d, r in labels.items() if r["quality"] == 1})
    got = {r["doc_id"]: r for r in QUERIES["op8_lm_scoring"](spark, SF).collect()}
    assert set(got) == set(want)
    for d, (n, score) in want.items():
        assert got[d]["n_tokens"] == n and got[d]["score"] == (score if score is None else pytest.approx(score, abs=1e-4))


def test_token_counts(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    want = {d: (d, len((r["text"] or "").encode()), n, n > 4096) for d, r in documents.items() for n in [len(sp.encode(r["text"] or ""))]}
    assert got == want


def test_hot_pretokens_of_any_length(spark):
    """Pre-tokens that many documents share, some too long to be broadcast or shuffled as they are."""
    import sentencepiece

    from strandline.llm import tokencount

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    shared = ["x" * 3000, "http://example.org/" + "ab/" * 30, "\u6f22\u5b57" * 40, "word"]
    texts = {d: " ".join([*shared, f"own{d}"] * (1 + d % 3)) for d in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for frequent in (0, 3, 1 << 17):
        got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, frequent=frequent).collect()}
        assert got == {d: len(sp.encode(t)) for d, t in texts.items()}
