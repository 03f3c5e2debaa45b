"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import tidied
from . import ann, chat, decontaminate, divergence, jaccard, langid, lmscore, packing, search, simhash, sql, tokenbin, tokencount, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.read_back(chat.windows(rows.unionByName(extra)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.encode_and_read(table(spark, sf_dir, "documents"), end_id=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), holdout=None)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def tidy_query(query):
    """The query; tables that it has written and its result doesn't read are deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(spark, lambda: query(spark, sf_dir))

    return run


QUERIES = {
    f.__name__: tidy_query(f)
    for f in (
        op1_language_id, op2_decontamination, op3_packing, op4_nearest, op5_chat, op6_token_files, op7_toxicity, op8_lm_scoring, op9_token_counts, op10_jaccard_join, op11_simhash,
        op12_source_divergence, op13_lexical_search,
    )
}

ORACLES = {
    "op2_decontamination": sql.DECONTAMINATION, "op5_chat": sql.CHAT, "op10_jaccard_join": sql.JACCARD, "op12_source_divergence": sql.DIVERGENCE, "op13_lexical_search": sql.SEARCH,
}
