"""The pipeline's stages on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import bpe

from .test_operators import check_packing, prose

EXTRA = "__row string, __gone int, __found string, __lang int, __toxic int, row int, good int, task int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base, vile = prose(1, 120), " ".join([*prose(5, 40).split(), *["vileword"] * 6])
    rows = [(i, prose(100 + i, 60), "en") for i in range(60)] + [(100 + i, f"{prose(200 + i, 50)} vileword grim vileword vileword", "de") for i in range(20)]
    rows += [(200, base, "en"), (201, base, "en"), (201, base, "en"), (None, base, None), (None, None, None), (202, None, "en"), (203, "", "en"), (204, "12 34 ...", "en"), (205, prose(6, 40_000), "de"), (206, vile, None)]
    rows += [(207, "leak " + prose(300, 15) + " tail", "en"), (208, prose(301, 90), "en"), (208, prose(302, 90), "en")]
    where = str(tmp_path_factory.mktemp("edge"))
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA
    full = [(d, t, lang, None, len(t or ""), "x", 1, "y", 2, 3, 4, 5, 6) for d, t, lang in rows]
    spark.createDataFrame(full, kind).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(20)] + [(None, None, None), (0, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([("a", prose(300, 15)), (None, prose(1, 120)), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows


def stages(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, out[-1], where)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        out.append(corpus_pipeline.materialise(got, "edges"))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_stages(spark, corpus):
    where, rows = corpus
    docs, letters, civil, distinct, clean = stages(spark, where)
    assert ids(docs) - ids(letters) == Counter([None, 202, 203, 204])  # without a letter
    assert set(ids(letters) - ids(civil)) == {100 + i for i in range(20)} | {206}
    assert ids(civil) - ids(distinct) == Counter({201: 2, None: 1})  # copies of 200; both texts of 208 stay
    assert ids(distinct) - ids(clean) == Counter([207])
    kept = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert Counter(kept) == Counter((d, t) for d, t, _ in rows if d is not None and t and t[0].isalpha() and d not in (201, 206, 207) and not 100 <= d < 120)
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, where)
    check_packing(got.collect(), kept, Tokenizer.from_file(bpe.tokenizer_path()), 2048, 0)


def test_empty_tables(spark, corpus, tmp_path):
    where, _ = corpus
    for empty in (("documents",), ("labels", "benchmark"), ("documents", "labels", "benchmark")):
        own = tmp_path / "-".join(empty)
        for name in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{where}/{name}.parquet")
            (df.limit(0) if name in empty else df).write.parquet(f"{own}/{name}.parquet")
        got = corpus_pipeline.run(spark, str(own)).collect()
        assert (len(got) == 0) == ("documents" in empty)
        if "documents" not in empty:  # nothing is toxic or leaked then
            assert {100, 206, 207} <= {r["doc_id"] for r in got}


def test_all_rows_alike(spark, tmp_path):
    spark.createDataFrame([(7, "the same text again and again here", "en", "s", 5)] * 50, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["piece"], r["offset"]) for r in got] == [(7, 0, 0)]
    assert np.isscalar(got[0]["length"])
