"""Each operator against brute force, its defined edge cases, and an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, bpe, chat, common, decontaminate, jaccard, langid, lmscore, packing, tokenbin, tokencount, toxicity

from ..oracle import SF, connection, same
from .conftest import prose

PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PLAIN_WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


# 1 ---------------------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    docs = table(spark, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_sums_match_single_texts(spark):
    texts = ["", "a", "ab", "abc", prose(4, 50), "Ünïcödé 漢字", "x" * 5]
    import pyarrow as pa

    data, off = common.flat(pa.array(texts))
    w = np.random.default_rng(0).normal(size=(2, 1 << langid.BITS)).astype(np.float32)
    got = langid.linear_sums(data, off, w)
    for t, row in zip(texts, got):
        np.testing.assert_allclose(row, w @ langid.frequencies(np.frombuffer(t.encode(), np.uint8)), atol=1e-5)
    assert sum((b - a for a, b in common.runs(off, 3)), 0) == len(texts)


def test_language_edges(spark, edge_docs, none_docs):
    got = {r["doc_id"]: r for r in langid.identify(edge_docs).collect()}
    assert langid.identify(edge_docs).count() == 15
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 7)) and got[0]["lang_pred"] in ("en", "de", "fr")
    kept = langid.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 11
    assert langid.identify(none_docs).count() == 0 and langid.keep_identified(none_docs).count() == 0
    one = langid.identify(edge_docs.where("lang = 'en' or lang is null"))
    assert {r["lang_pred"] for r in one.collect()} == {"en", "und"}
    assert {r["lang_pred"] for r in langid.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 2 ---------------------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, width):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        b = plain_words(t)
        for p in {tuple(b[i : i + width]) for i in range(max(1, len(b) - width + 1))} if b else ():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_decontamination(spark, edge_docs, block):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(40)]
    items = [(i, " ".join(rng.choice("abA,") for _ in range(rng.choice([0, 1, 2, 3, 5, 8])))) for i in range(12)] + [(3, "a b a"), (99, None)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), width=4, block_windows=block)
    want = {d: brute_hits(t, items, 4) for d, t in docs}
    assert {r[0]: tuple(r[1:6]) for r in got.collect()} == want
    one = spark.createDataFrame([(2, prose(1, 120)[:200])], "item_id bigint, text string")
    hit = {r["doc_id"] for r in decontaminate.contamination(edge_docs, one).where("contaminated").collect()}
    assert hit == {0, 1, 2, None}
    kept = decontaminate.keep_clean(edge_docs, one)
    assert kept.columns == edge_docs.columns and kept.count() == 11 and kept.first()["__found"] == "x"


def test_decontamination_edges(spark, edge_docs, none_docs):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(edge_docs, nothing).where("n_hit = 0 and not contaminated").count() == 15
    assert decontaminate.contamination(none_docs, nothing).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------------


def optimum(items, cap):
    """Fewest bins, by trying every placement."""
    best = len(items)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best and rest or len(rooms) > best:
            return
        if not rest:
            best = min(best, len(rooms))
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= rest[0]}.values()):
            place(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]])
        place(rest[1:], [*rooms, cap - rest[0]])

    place(sorted(items, reverse=True), [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.randint(4, 12)
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce_dominated(Counter(items), cap)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sorted(rest + [k for runs, n in fixed for k, c in runs for _ in range(c * n)]) == sorted(items)
        assert all(sum(k * c for k, c in runs) <= cap for runs, _ in fixed)
        assert sum(n for _, n in fixed) + (optimum(rest, cap) if rest else 0) == optimum(items, cap)


def check_packing(rows, docs, tokenizer, cap, end):
    by_doc = {}
    for d, t in docs:
        by_doc.setdefault(d, []).append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4"))
    want = Counter((d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for d, texts in by_doc.items() for ids in texts for k, (s, n) in enumerate(packing.cut(len(ids), cap)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= cap
    return len(bins)


@pytest.mark.parametrize("cap", [16, 2048])
def test_packing(spark, edge_docs, none_docs, tokenizer, cap):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    rows = packing.pack(edge_docs.repartition(3), cap, 0).collect()
    bins = check_packing(rows, docs, tokenizer, cap, 0)
    assert bins <= -(-sum(r["length"] for r in rows) // cap) + 1
    assert packing.pack(none_docs).count() == 0
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(1, 2) == [(0, 1)]


# 4 ---------------------------------------------------------------------------------------------------------------------------


def test_multi_index_probing_finds_every_code_in_reach():
    codes = np.random.default_rng(0).integers(0, 16, size=(300, 5)).astype(np.uint32)
    index = ann.BlockIndex(codes)
    for q in codes[:20]:
        d = np.bitwise_count(codes ^ q).sum(axis=1)
        for r in range(12):
            assert set(index.within(q, r)) == set(np.flatnonzero(d <= r))


def brute_nearest(rows, every, k):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            out[q] = [i for _, i in sorted((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q)][:k]
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_nearest(spark, norms):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)) + 3 * rng.standard_normal((5, 24))[rng.integers(0, 5, 1500)]
    x = x if norms else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = {i: x[i] for i in range(1500)}
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None] + [0.0] * 22), (2080, [1.0]), (2100, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()] + bad, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, block=400, queries=30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(x[r["query_id"]], x[r["vec_id"]])), rel=1e-12)
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 and len(set(v)) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_nearest_edges(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert ann.nearest(spark.createDataFrame([], kind)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, -0.5], None), (3, [0.5, 0.5], 2)], kind)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, 0.5)]
    assert ann.nearest(few.limit(1)).count() == 0
    same_vector = spark.createDataFrame([(i, [1.0, 1.0], 1) for i in range(100)], kind)
    got = ann.nearest(same_vector, block=30).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(21) if i != 20]


def test_nearest_takes_components_of_any_size(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6))
    for scale in (1e200, 1e-200, 1.0):
        df = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        rows = ann.nearest(df).where("query_id = 20").orderBy("rank").collect()
        assert len(rows) == 20 and [r["rank"] for r in rows] == list(range(1, 21))
        with np.errstate(over="ignore", invalid="ignore"):
            want = [float((x[20] * scale) @ (x[r["vec_id"]] * scale)) for r in rows]
        want = [-np.inf if math.isnan(w) else w for w in want]  # a score that isn't a number counts as the least
        assert all(r["score"] == w or abs(r["score"] - w) <= 1e-9 * abs(w) for r, w in zip(rows, want))
    mixed = spark.createDataFrame([(i, (v * (1e200 if i % 2 else 1e-200)).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    assert ann.nearest(mixed).count() == 20 * 20


def test_nearest_query_has_the_recall(spark):
    from strandline.llm.queries import op4_nearest

    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, "embeddings").collect()}
    got = {}
    for r in op4_nearest(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(x, 20, 20)
    assert set(got) == set(want) and np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_block_keeps_few_of_equal_vectors_and_all_answers():
    rng = np.random.default_rng(3)
    v = np.concatenate([np.repeat(rng.standard_normal((1, 5)), 300, axis=0), rng.standard_normal((200, 5))])
    ids = rng.permutation(500)
    ids[10:14] = ids[9]  # one row four times more
    kept, w = ann.searched(ids, v, 20)
    assert (np.diff(kept) >= 0).all() and (w == v[0]).all(axis=1).sum() == 21
    assert sorted(kept[(w == v[0]).all(axis=1)]) == sorted(set(ids[:300]))[:21] and len(kept) == 221


# 5 ---------------------------------------------------------------------------------------------------------------------------


def conversations(spark):
    rng = random.Random(2)
    part = ["</s>", "[INST] ", " [/INST]", "<s>", "&", "&lt;", "&amp;amp;", "word ", "\n", "é😀", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[", None]), "".join(rng.choice(part) for _ in range(rng.choice([0, 2, 40, 300])))) for c in range(25) for t in range(rng.randint(1, 12))]
    rows += [(50, 0, "user", None), (51, None, "assistant", "no turn"), (None, 0, "assistant", "no id"), (52, 1, "assistant", "twice"), (52, 1, "assistant", "twice"), (53, 0, "system", "rules")]
    rows += [(53, t, "user" if t % 2 else "assistant", "x" * 160) for t in range(1, 16)] + [(54, 0, "assistant", "y" * 10_000)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")


def test_chat_round_trip(spark):
    rows, df = conversations(spark)
    got = {r["conv_id"]: r for r in chat.read_back(chat.windows(df, budget=256, history=2, history_tokens=64)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def turns_of(formatted):
    return [t + "</s>" for t in formatted.split("</s>")[:-1]]


def test_chat_windows_keep_their_budget_of_tokens(spark, tokenizer):
    _, df = conversations(spark)
    rng = random.Random(8)
    cjk = [(c, t, "user" if t % 2 else "assistant", "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.choice([3, 60, 200, 900])))) for c in range(20) for t in range(12)]
    for rows, budget in ((df, 256), (spark.createDataFrame(cjk, "conv_id bigint, turn bigint, role string, text string"), 1024), (table(spark, "conversations"), 2048)):
        got = chat.windows(rows, budget=budget, history=2, history_tokens=budget // 4).collect()
        assert len(got) > 20
        for r in got:
            turns = turns_of(r["formatted"])
            own = turns[1:] if turns[0].startswith("<s>[INST] system [/INST]") else turns  # a turn that doesn't fit stands alone, with the system turn
            assert len(tokenizer.encode(r["formatted"], add_special_tokens=False).ids) <= budget or len(own) <= 1


def test_chat_history_and_system_turn(spark):
    _, df = conversations(spark)
    rows = chat.windows(df, budget=800, history=2, history_tokens=400).where("conv_id = 53").orderBy("window").collect()
    assert len(rows) > 3 and all(len(r["formatted"].encode()) <= 800 for r in rows)
    assert all(r["formatted"].startswith("<s>[INST] system [/INST]rules</s>") for r in rows) and any(r["n_repeated"] > 1 for r in rows)
    assert len(chat.windows(df, budget=256).where("conv_id = 54").collect()) == 1


def test_chat_takes_true_counts(spark):
    rows = [(0, t, "user" if t % 2 else "assistant", "word " * 20, 10 if t < 8 else None) for t in range(16)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint")
    got = chat.windows(df, budget=40, history=0, history_tokens=0, tokens="n").orderBy("window").collect()
    assert [len(turns_of(r["formatted"])) for r in got] == [4, 4] + [1] * 8  # rows without a count fall back to their bytes
    assert chat.read_back(chat.windows(df, budget=40, tokens="n")).first()["n_turns"] == 16


def test_chat_is_native(spark):
    _, df = conversations(spark)
    plan = chat.read_back(chat.windows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 6 ---------------------------------------------------------------------------------------------------------------------------


def test_chunk_encoder_is_exact(tokenizer):
    rng = random.Random(5)
    part = [" ", "  ", "\n", "\t", " \n", "\n ", "a", "bc", "É", "ñ", "12", "'s", ",", "!", "<|endoftext|>", "　", "漢", "😀", "\x1c", "\x85", "\x00", ". ", ", ", "."]
    enc = bpe.ChunkEncoder(cache_chunks=50)
    texts = ["".join(rng.choice(part) for _ in range(rng.randint(0, 9))) for _ in range(4000)] + [None]
    for t, ids in zip(texts, enc.encode(texts, slice_chars=500)):
        assert np.frombuffer(ids, enc.dtype).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    assert len(enc.cache) < 2000


def test_token_files(spark, edge_docs, none_docs, tokenizer, tmp_path):
    docs = edge_docs.unionByName(edge_docs.select(*[(F.lit(prose(9, 30)) if c == "text" else F.col("doc_id") + 100 if c == "doc_id" else F.col(c)).alias(c) for c in edge_docs.columns]))
    folder = str(tmp_path / "files")
    tokenbin.write_tokens(docs.repartition(3), folder)
    got = tokenbin.read_tokens(spark, folder, with_ids=True).orderBy("start").collect()
    key = lambda d: (d is not None, d)
    want = sorted(((r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda p: key(p[0]))
    assert [r["doc_id"] for r in got] == [d for d, _ in want] and Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(i)) for d, i in want)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert tokenbin.fetch(spark, folder, 11) == [dict(want)[11]] and len(tokenbin.fetch(spark, folder, 3)) == 2 and tokenbin.fetch(spark, folder, 77) == []
    assert tokenbin.encode_and_read(none_docs).count() == 0


def test_fetch_skips_shards_without_the_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "SHARD_BYTES", 2000)
    folder = str(tmp_path / "files")
    tokenbin.write_tokens(spark.createDataFrame([(i, prose(i, 80)) for i in range(300)], "doc_id bigint, text string"), folder)
    shards = spark.read.parquet(f"{folder}/shards")
    assert shards.count() > 10 and shards.where("least <= 77 and largest >= 77").count() == 1
    plan = tokenbin.holding(spark, folder, 77)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(least,77)" in plan and "GreaterThanOrEqual(largest,77)" in plan and "frames" not in plan.split("ReadSchema")[1]
    assert len(tokenbin.fetch(spark, folder, 77)) == 1


def test_dictionary_is_checked(spark, tmp_path):
    folder = str(tmp_path / "files")
    tokenbin.write_tokens(spark.createDataFrame([(i, prose(i, 80)) for i in range(300)], "doc_id bigint, text string"), folder)
    digest, found = tokenbin.dictionary_of(spark, folder)
    assert len(found) > 0 and hashlib.sha256(found).hexdigest() == digest
    spark.createDataFrame([("0" * 64, bytearray(found))], "dict_sha256 string, dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        tokenbin.read_tokens(spark, folder)


# 7 ---------------------------------------------------------------------------------------------------------------------------


def brute_segments(scores):
    def inner(a, b):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return inner(a, i) + [(i, j, sum(scores[i:j]))] + inner(j, b)

    return inner(0, len(scores))


def test_maximal_segments():
    rng = random.Random(0)
    for _ in range(500):
        items = [(i, rng.choice([1.0, 2.0, -1.4, 0.7, -3.0]) + rng.random() / 100) for i in range(rng.randint(1, 12)) if rng.random() < 0.6]
        scores = [-0.51] * 12
        for i, s in items:
            scores[i] = s
        assert [(a, b, pytest.approx(s)) for a, b, s in toxicity.maximal_segments(items, -0.51)] == brute_segments(scores)


def toxic_corpus(spark, n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = prose(i, 60).split()
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "grimword" + rng.choice("abcdef") + rng.choice("xyz")]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + [(0, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark, edge_docs, none_docs):
    docs, labels = toxic_corpus(spark)
    got = toxicity.score_toxicity(docs, labels).join(labels.where("toxic is not null"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    some = next(r for r in got if r["predicted"] == 1)
    text = toxicity.tokens(docs.where(F.col("doc_id") == some["doc_id"]).first()["text"])
    assert some["segments"] and any(w[:4] in ("vile", "grim") for s in some["segments"] for w in text[s["start"] : s["end"]])
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 520
    model = toxicity.fit(docs, labels)
    assert {(r["score"] is not None) for r in edge_docs.select(toxicity.scored(common.text_column(edge_docs), model)["score"].alias("score")).collect()} == {True}
    assert toxicity.score_toxicity(edge_docs, labels.limit(0)).where("predicted = 0").count() == 15
    assert toxicity.score_toxicity(none_docs, labels).count() == 0
    assert toxicity.keep_civil(edge_docs, labels).columns == edge_docs.columns


def test_karlin_lambda():
    s, p = np.array([2.0, -1.0]), np.array([0.1, 0.3])
    r = toxicity.karlin_lambda(s, p, -0.5)
    assert (p * np.exp(r * s)).sum() + 0.6 * math.exp(-0.5 * r) == pytest.approx(1, abs=1e-6)


# 8 ---------------------------------------------------------------------------------------------------------------------------


def test_lm_scores_match_plain_counts(spark):
    docs, labels = toxic_corpus(spark, 80)
    labels = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    got = {r["doc_id"]: r for r in lmscore.score_documents(docs, labels, vocab_size=40, classes=8).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {d: plain_words(t) for d, t in texts.items()}
    counts = Counter(w for ws in words.values() for w in ws)
    top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:31]
    ids = {w: i + 1 for i, w in enumerate(top)}
    sym = {d: [ids.get(w, 32 + zlib.crc32(w.encode()[-3:]) % 8) for w in ws] for d, ws in words.items()}
    good = {d for d in sym if d % 2 == 0 and zlib.crc32(str(d).encode()) % 5 != 0}

    def model(which):
        pairs, first, single = Counter(), Counter(), Counter()
        for d in which:
            for a, b in zip([0, *sym[d]], sym[d]):
                pairs[a, b] += 1
                first[a] += 1
                single[b] += 1
        total = sum(single.values())
        uni = lambda b: (single[b] + 0.5) / (total + 0.5 * 40)
        return lambda a, b: -math.log(0.7 * pairs[a, b] / first[a] + 0.3 * uni(b) if first[a] else uni(b))

    t, b = model(good), model(sym)
    for d, s in sym.items():
        pairs = list(zip([0, *s], s))
        assert got[d]["n_tokens"] == len(s)
        assert got[d]["score"] == pytest.approx(np.mean([t(*p) for p in pairs]) - np.mean([b(*p) for p in pairs]), abs=1e-4)


def test_lm_edges(spark, edge_docs, none_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = lmscore.score_documents(edge_docs, labels).collect()
    assert len(got) == 15 and all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lmscore.score_documents(none_docs, labels).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [0, 20, 1 << 17])
def test_token_counts(spark, edge_docs, none_docs, frequent):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    got = tokencount.count_tokens(edge_docs, 4096, frequent=frequent).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    assert Counter(map(tuple, got)) == Counter((d, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for d, t in rows)
    assert tokencount.count_tokens(none_docs).count() == 0


def test_pretokens_add_up():
    c = tokencount.counter(bpe.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(6)
    part = [" ", "  ", "\n", "\t", " \n", "a", "bc", "É", "12", ",", ".", ". ", "!", "</s>", "<s>", "▁", "漢", "😀", "\x00", "_"]
    for _ in range(4000):
        t = "".join(rng.choice(part) for _ in range(rng.randint(0, 9)))
        units, points = tokencount.pretokens(t)
        assert sum(c.count(units)) + points == len(c.sp.encode(t)), repr(t)


# 10 --------------------------------------------------------------------------------------------------------------------------


def brute_links(docs, n=5, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = plain_words(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links = {d: {e for e in sets if e != d and sets[d] and len(sets[d] & sets[e]) / len(sets[d] | sets[e]) >= threshold} for d in sets}
    root = {}
    for d in sorted(sets):
        if d not in root:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = d
                    todo += links[x]
    return {d: (root[d], len(links[d])) for d in sets}


def near_copies(seed=0, groups=6, size=25):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = prose(1000 + g, rng.choice([8, 40, 200])).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(base) + str(rng.randrange(50))
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 500)
    docs = near_copies()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == brute_links(docs)


def test_jaccard_edges(spark, edge_docs, none_docs):
    got = jaccard.link(edge_docs).collect()
    by = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got}
    assert len(got) == 15 and all(by[i] == (0, 3) for i in (0, 1, 2, None)) and by[8] == (8, 1) and by[10] == (8, 1)
    assert all(by[i] == (i, 0) for i in (4, 5, 6, 9, 11, 12)) and by[3] == (3, 1)
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 11, 12] and kept.where("doc_id is null").count() == 0
    assert jaccard.link(none_docs).count() == 0 and jaccard.keep_one(none_docs).count() == 0


def test_rows_of_one_id_with_different_texts_are_both_kept(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.link(docs).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, 1), (None, None, 1), (None, None, 1), (3, 3, 0)])
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect())
    assert kept == Counter([(1, a), (1, b), (None, c), (3, "")])


def test_bands_reach_the_recall():
    with pytest.raises(ValueError):
        jaccard.bands(0.05, 0.9999)
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        b, r = jaccard.bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall and b * r <= 128


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    with pytest.raises(RuntimeError):
        jaccard.components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), most=1)


def test_a_long_path_is_one_component(spark):
    path = spark.range(1 << 12).selectExpr("(id * 2654435761) % 4294967296 AS a", "((id + 1) * 2654435761) % 4294967296 AS b")
    got = jaccard.components(spark, path).collect()
    assert len(got) == (1 << 12) + 1 and {r["root"] for r in got} == {0}


# Queries ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_chat", "op10_jaccard_join"])
def test_same_rows_as_sql(spark, name):
    from strandline.llm.queries import ORACLES, QUERIES

    same(QUERIES[name](spark, SF), connection(), ORACLES[name])


def test_pipeline(spark, tokenizer):
    import corpus_pipeline

    docs = table(spark, "documents")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = common.materialise(stage(spark, step, SF), "test")
        assert step.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    rows = docs.collect()
    first = [(r["doc_id"], r["text"]) for r in rows if any(c.isalpha() for c in r["text"] or "")]
    bad = {r["doc_id"] for r in toxicity.score_toxicity(spark.createDataFrame(first, "doc_id bigint, text string"), table(spark, "labels")).where("predicted = 1").collect()}
    second = [(d, t) for d, t in first if d not in bad]
    stay = {d for d, (root, _) in brute_links(second).items() if root == d}
    third = [(d, t) for d, t in second if d in stay]
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    last = {d: t for d, t in third if not brute_hits(t, items, 10)[4]}
    assert kept == last
    check_packing(corpus_pipeline.run(spark, SF).collect(), list(last.items()), tokenizer, 2048, 0)
