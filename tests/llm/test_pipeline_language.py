"""What the language stage finds stays with the documents, up to the packed pieces."""

import corpus_pipeline
from strandline.llm import langid

WORDS = {"en": "the old house stands near the river and they walk there every morning", "de": "das alte Haus steht nahe am Fluss und sie gehen dort jeden Morgen hin"}


def test_the_language_found_reaches_the_result(spark, tmp_path):
    rows = [(i, f"{WORDS[lang]} {i} {WORDS[lang][i % 7 :]}", lang if i < 40 else None) for i in range(60) for lang in [("en", "de")[i % 2]]]
    rows.append((60, WORDS["de"], "en"))
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert {i: want[i] for i in range(40, 61)} == {**{i: ("en", "de")[i % 2] for i in range(40, 60)}, 60: "de"}
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.identified(spark, docs, str(tmp_path)).collect()} == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["lang"] == want[r["doc_id"]] for r in got)
