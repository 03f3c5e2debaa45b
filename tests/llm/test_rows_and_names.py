"""Row numbers hold when Spark cuts a scan otherwise half-way; columns of any name stay; probes read few rows; windows of many items are dealt out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, decontaminate, jaccard, langid, lmscore, toxicity

from .conftest import prose
from .test_operators import brute_hits

CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def recut(spark, monkeypatch):
    """Makes a function of a module change how many tasks later scans are cut into."""

    def set_on(module, name):
        inner = getattr(module, name)

        def outer(*args, **options):
            spark.conf.set(CORES, "61")
            return inner(*args, **options)

        monkeypatch.setattr(module, name, outer)

    yield set_on
    spark.conf.unset(CORES)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    rows = []
    for k in range(60):
        base = prose(1000 + k, 80).split()
        near = [*base]
        near[40] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    random.Random(0).shuffle(rows)
    where = str(tmp_path_factory.mktemp("files") / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(36).write.parquet(where)
    return where, rows


def test_links_hold_under_other_cores(spark, many_files, recut):
    recut(jaccard, "gram_sets")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link(spark.read.parquet(many_files[0])).collect()}
    assert got == {d: (d - d % 2, 1) for d in range(120)}
    spark.conf.unset(CORES)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(spark.read.parquet(many_files[0])).collect()) == list(range(0, 120, 2))


def test_hits_hold_under_other_cores(spark, many_files, recut):
    where, rows = many_files
    texts = dict(rows)
    items = [(f"i{k}", " ".join(texts[k].split()[5:40])) for k in range(0, 120, 7)]
    recut(decontaminate, "together")
    got = {r["doc_id"]: r for r in decontaminate.contamination(spark.read.parquet(where), spark.createDataFrame(items, "item_id string, text string"), block_windows=60).collect()}
    for d, text in texts.items():
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"]) == brute_hits(text, items, 10)[:3]


def test_scores_hold_under_other_cores(spark, many_files, recut):
    labels = spark.createDataFrame([(d, int(d % 5 == 0)) for d in range(120)], "doc_id bigint, quality int")
    scored = lambda: {r["doc_id"]: tuple(r) for r in lmscore.score_documents(spark.read.parquet(many_files[0]), labels, holdout=None, frequent=8, dense=4).collect()}
    want = scored()
    recut(lmscore, "rarer_pairs")
    recut(lmscore, "dense_counts")
    got = scored()
    assert set(got) == set(want) and all(got[d] == pytest.approx(want[d], rel=1e-6) for d in want)


def test_marks_of_rows_from_several_partitions():
    rng = np.random.default_rng(1)
    rows = np.concatenate([(p << 33) + np.arange(n) for p, n in ((0, 40), (3, 1), (7, 90))])
    good = rng.choice(rows, 50, replace=False)
    assert lmscore.Marks.of(good)(rng.permutation(rows)).sum() == 50
    mixed = rng.permutation(rows)
    assert (lmscore.Marks.of(good)(mixed) == np.isin(mixed, good)).all() and len(lmscore.Marks.of(good[:0])(rows[:0])) == 0


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, prose(i, 40), "en", 1, 2, 3, 4) for i in range(30)] + [(100 + i, f"{prose(50 + i, 30)} vileword grim vileword", "de", 1, 2, 3, 4) for i in range(12)] + [(200, prose(0, 40), "en", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `a.b` int, r int, `t``c` int, `__row` int")
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(12)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([("x", rows[3][1]), ("y", rows[4][1])], "item_id string, text string")
    for got, n in (
        (langid.keep_identified(docs), 43),
        (toxicity.keep_civil(docs, labels), 31),
        (jaccard.keep_one(docs), 42),
        (decontaminate.keep_clean(docs, items), 41),
        (decontaminate.keep_clean(docs, items, block_windows=1), 41),
    ):
        assert got.columns == docs.columns and got.count() == n
        assert {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3, 4)}


def test_a_window_of_many_items_is_dealt_out(spark):
    shared = prose(7, 12)
    items = spark.createDataFrame([(k, shared) for k in range(400)], "item_id bigint, text string")
    sizes = [r["count"] for r in decontaminate.patterns(items, 10).groupBy(F.pmod(F.xxhash64("pattern", "item"), F.lit(8))).count().collect()]
    assert sum(sizes) == 1200 and max(sizes) < 220
    got = decontaminate.contamination(spark.createDataFrame([(1, "a " + shared), (2, "b")], "doc_id bigint, text string"), items, block_windows=150).orderBy("doc_id").collect()
    assert [(r["n_items"], r["n_hit"]) for r in got] == [(400, 12), (0, 0)]


def test_probes_read_probed_buckets_alone():
    """Codes in tight clusters: a query reads the buckets near it, not the block."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 256, size=(200, 8))
    codes = (centres[rng.integers(0, 200, 8000)] ^ (1 << rng.integers(0, 8, (8000, 8))) * (rng.random((8000, 8)) < 0.1)).astype(np.uint32)
    index = ann.BlockIndex(codes, 8)
    for q in codes[:20]:
        before = index.read
        got = index.within(q, 7)
        assert set(got) == set(np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= 7))
        assert 0 < index.read - before < 8000
    wide = ann.BlockIndex(codes, 8)
    assert len(wide.within(codes[0], 64)) == 8000 and wide.read == 8 * 8000


def test_token_files_are_the_same_each_time_and_split_hot_ids(spark, tmp_path):
    from strandline.llm import tokenbin

    docs = spark.createDataFrame([(k, prose(k, 60)) for k in range(40)] + [(7, prose(100 + k, 30)) for k in range(200)] + [(None, prose(500 + k, 20)) for k in range(100)], "doc_id bigint, text string")
    files = []
    for n in (2, 7):
        folder = tokenbin.write_tokens(docs.repartition(n), str(tmp_path / f"files{n}"), path=tokenbin.tokenizer_path())
        shards = spark.read.parquet(f"{folder}/shards").orderBy("part", "shard").collect()
        files.append([(r["dict_sha256"], r["doc_ids"], r["n_tokens"], bytes(r["frames"])) for r in shards])
        assert sum(7 in r["doc_ids"] for r in shards) > 1 and sum(None in r["doc_ids"] for r in shards) > 1
    flat = [[(d, n) for _, ids, sizes, _ in f for d, n in zip(ids, sizes)] for f in files]
    assert flat[0] == flat[1] and len(flat[0]) == 340 and {f[0] for f in files[0]} == {f[0] for f in files[1]}
    assert [d for d, _ in flat[0]] == sorted((d for d, _ in flat[0]), key=lambda d: -1 if d is None else d)


def test_places_follow_the_order_of_ids():
    from strandline.llm.tokenbin import place

    rng = random.Random(2)
    for cuts in ([], [5], [3, 5, 5, 5, 9], [5, 5, 5]):
        rows = sorted(((rng.choice([None, 1, 3, 4, 5, 5, 5, 6, 9, 10]), rng.randbytes(16)) for _ in range(300)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        parts = [place(cuts, 2, d, h) for d, h in rows]
        assert parts == sorted(parts) and set(parts) <= set(range(len(cuts) + 3))
    assert len({place([3, 5, 5, 5, 9], 0, 5, rng.randbytes(16)) for _ in range(200)}) == 3
