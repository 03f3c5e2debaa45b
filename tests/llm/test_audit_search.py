"""SimHash near duplicates, source divergence and lexical search against brute force, and their defined cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strandline.llm import common, divergence, search, simhash
from strandline.llm.queries import ORACLES, QUERIES

from ..oracle import SF, connection, same
from .conftest import prose
from .test_operators import plain_words, table

# 11 --------------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = low.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    ws = [w for w in ws if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """The smallest place of the component of each, by comparing all pairs."""
    bits = np.array(fps, np.uint64)
    root = list(range(len(fps)))
    near = [np.flatnonzero(np.bitwise_count(bits ^ b) <= radius).tolist() for b in bits]
    for start in range(len(fps)):
        todo = [start] if root[start] == start else []
        while todo:
            for b in near[todo.pop()]:
                if root[b] > start:
                    root[b] = start
                    todo.append(b)
    return root


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_simhash"](spark, SF).collect()}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[d]) for d in ids]
    assert [got[d]["fingerprint"] for d in ids] == [f"{f:016x}" for f in fps]
    assert [got[d]["component_id"] for d in ids] == [ids[k] for k in plain_components(fps)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [4, 64, 2048])
def test_variants_lose_no_link(spark, most):
    """Clusters of fingerprints around few centres, so that variants are crowded and are cut again two times over."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps, key=signed)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in simhash.links(df, most=most).collect():
        a, b = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = defaultdict(set)
    for x, k in zip(fps, plain_components(fps)):
        want[k].add(x)
    have = defaultdict(set)
    for x in fps:
        have[find(x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_simhash_edges(spark, edge_docs, none_docs, monkeypatch):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count() and simhash.near_duplicates(none_docs).collect() == []
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    assert all(r["fingerprint"] == f"{plain_fingerprint(texts[r['doc_id']]):016x}" for r in got)
    assert {by[d][0]["fingerprint"] for d in (4, 5, 6)} == {"0" * 16} and {by[d][0]["component_id"] for d in (4, 5, 6)} == {4}
    assert by[0][0]["component_id"] == by[1][0]["component_id"] == 0 and by[10][0]["component_id"] == 8 and len(by[3]) == 2
    nameless = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 2)], "doc_id bigint, text string, fp int")
    assert [r["component_id"] for r in simhash.near_duplicates(nameless).collect()] == [None, None]


def test_words_of_long_texts_come_in_slices():
    raw = ("Ab  cde\tf\n" * 50 + "x" * 100 + " y z").encode()
    for size in (1, 7, 64, 1 << 20):
        assert [w for ws in common.word_slices(raw, simhash.SPACED, size) for w in ws] == raw.lower().split()


def test_fingerprint_goes_on_across_slices(monkeypatch):
    text, whole = prose(9, 500), simhash.fingerprint(prose(9, 500).encode())
    slices = common.word_slices
    for size in (3, 40, 999):
        monkeypatch.setattr(simhash, "word_slices", lambda raw, t, s=size: slices(raw, t, s))
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b"one two") == signed(plain_fingerprint("one two"))


# 12 --------------------------------------------------------------------------------------------------------------------------


def plain_audit(rows, least=10, top=10):
    letters = lambda t: "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in t or "").translate({c: c + 32 for c in range(65, 91)}).split(" ")
    n, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        ws = [w for w in letters(text) if w]
        n[lang or "", source or ""].update(ws)
        df[lang or ""].update(set(ws))
    out = []
    for lang in df:
        kept = [t for t, c in df[lang].items() if c >= least]
        groups, v = {s: c for (x, s), c in n.items() if x == lang}, len(kept)
        whole = sum(groups.values(), Counter())

        def p(c, t, total, v=v):
            return 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * v)

        totals = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, t, totals[s]), p(o, t, totals[x])) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [(p(c, t, totals[s]), p(whole, t, sum(totals.values())), t) for t in kept if c[t]]
            terms = [(-f(a, b), t) for a, b, t in terms if a > b]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())))]
    return sorted(out)


def audited(df, **options):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("block, held", [(256, 300_000), (2, 5)])
def test_audit_is_exact(spark, monkeypatch, block, held):
    """With blocks of two sources and counts given on at every document the sums are the same."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(3)
    words = ["Über", "a", "b", "c", "É", "straße", "x9y", "the"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None, "s4", "s5"]), " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 12))) + ".") for _ in range(300)]
    rows += [("xx", "only", "a b c"), ("yy", "p", None), ("yy", "q", "a"), ("en", "no terms", "123 ,."), ("en", "s1", None)]
    df = spark.createDataFrame([(k % 50, t, lang, s, 1, "clash") for k, (lang, s, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n int, term string").repartition(3)
    want = plain_audit(rows)
    assert audited(df) == want and {r[0] for r in want} == {"en", "de", "", "yy"}
    assert ("yy", "p", "pair", "q", 0, 1) in want and any(r[1] == "no terms" for r in want)


def test_audit_edges(spark, edge_docs, none_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in edge_docs.collect()]
    assert audited(edge_docs) == plain_audit(rows) and audited(edge_docs, least=1, top=3) == plain_audit(rows, 1, 3)
    assert audited(none_docs) == []


def test_chances_beyond_64_bits_are_exact(spark):
    n, total, v = 9_000_000_000_000_000, 9_100_000_000_000_000, 123_456
    row = spark.createDataFrame([(n, total, v)], "n bigint, total bigint, v bigint").select(divergence.chance("n", "total", "v")).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)


# 13 --------------------------------------------------------------------------------------------------------------------------


def plain_search(docs, queries, k=20):
    found = [(d, Counter(plain_words(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(Counter)
    for q, t in queries:
        if q is not None:
            asked[q].update(plain_words(t))
    out = set()
    for q, terms in asked.items():
        rows = []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out |= {(q, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1)}
    return out


def searched(docs, queries, **options):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(docs, queries, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"most_docs": 7, "block_terms": 40}, {"most_bytes": 1, "block_terms": 1}, {"k": 3, "most_docs": 30}])
def test_search_is_exact(spark, options):
    """Shards of one document or of all, blocks of one query or of all, few places and many ties: the same rows."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(rng.randrange(400), " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 1, 2, 8, 30])))) for _ in range(500)] + [(None, "w40 w41"), (None, "w40"), (401, None), (402, "..."), (-5, "W40 w40")]
    queries = [(q, " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 12])))) for q in range(12)] + [(12, "w40 w40 absent"), (13, "absent"), (14, None), (15, ""), (None, "w1"), (0, "w7 w8")]
    a = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id bigint, text string, item_id string, score int").repartition(5)
    b = spark.createDataFrame([(*q, 1) for q in queries], "item_id bigint, text string, doc_id int")
    assert searched(a, b, **options) == plain_search(docs, queries, options.get("k", 20))


def test_common_terms_leave_the_merge(spark):
    """The best are found among many documents of common terms although few of those are scored."""
    rng = random.Random(1)
    texts = [["common", "usual"] + rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 6)) + (["rare"] if k % 50 == 0 else []) for k in range(2000)]
    row = {c: v[0] for c, v in zip(["ids", "sizes", "terms", "dfs", "ends", "postings"], search.shard(list(range(2000)), [Counter(w.encode() for w in t) for t in texts]).columns[2:])}
    import pyarrow as pa

    names = [b"common", b"rare", b"usual"]
    weight = [math.floor(1000 * math.log(4002 / (2 * sum(n.decode() in t for t in texts) + 1))) for n in names]
    block = search.Block(pa.array(names, pa.binary()), [[(0, 1), (1, 2), (2, 1)]], weight)
    part = search.Shard(row, block, 2000, sum(map(len, texts)))
    assert set(part.lists) == {1} or weight[0] > 0
    best: list = []
    search.walk(part, block.queries[0], best, 5)
    want = plain_search([(k, " ".join(t)) for k, t in enumerate(texts)], [(0, "common rare rare usual")], 5)
    assert {(s, -i) for s, i in best} == {(s, d) for _, _, d, s in want}


def test_numbers_are_packed_and_unpacked():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 40, 5, (1 << 62) + 3])
    data, ends = search.packed(values)
    assert (search.unpacked(data) == values).all() and ends[0] == 1 and ends[-1] == len(data)
    assert len(search.packed(values[:0])[0]) == 0 and len(search.unpacked(data[:0])) == 0


def test_search_edges(spark, edge_docs, none_docs):
    queries = spark.createDataFrame([("q", "short one kappa 123"), ("r", prose(1, 120)), ("s", "漢字")], "item_id string, text string")
    got = searched(edge_docs, queries)
    assert got == plain_search([(r["doc_id"], r["text"]) for r in edge_docs.collect()], [tuple(r) for r in queries.collect()])
    assert searched(none_docs, queries) == set() and searched(edge_docs, queries.limit(0)) == set()


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_lexical_search"])
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, SF), connection(), ORACLES[name])
