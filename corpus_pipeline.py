"""The corpus pipeline: language ID, toxicity, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), keeps the columns of documents, and works on all rows that the stage before it kept;
the last gives the packed pieces. Results are written as Parquet and read again between stages.

Defined cases, for every stage: extra columns stay, whatever their names, until packing ignores all but the language; a null source, language or size
means nothing to it; rows are judged one by one, so rows that repeat an id with another text are documents of their own, and rows
with a null id are documents too (they are never labelled, and give way to a copy that has an id). Texts are taken whole. An empty
table gives an empty table. Without labels no document is toxic, without benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, jaccard, langid, packing, toxicity
from strandline.sources.staging import discard, materialise, tidied


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names the language of each text in ``lang``, whatever stood there, and drops documents without one: null and empty texts, and texts without a letter."""
    return langid.keep_identified(docs, into="lang")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more for toxicity; of equal texts all go or none."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and the first row of those that repeat it."""
    return jaccard.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any window of a benchmark item; items without a text or id are none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row that repeats is packed each time. Pieces keep the language of their document."""
    return packing.pack(docs, carry=("lang",))


STAGES = [("language ID", identified), ("toxicity", civil), ("n-gram Jaccard join", distinct_texts), ("benchmark decontamination", uncontaminated), ("best-fit packing", packed)]

#: Learned models and a tokenizer stand in the way of SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        last = k == len(STAGES) - 1
        got = tidied(spark, lambda docs=docs, k=k, stage=stage, last=last: stage(spark, docs, sf_dir) if last else materialise(stage(spark, docs, sf_dir), f"stage{k}"))
        if k and not last:
            discard(docs)  # nothing reads the stage before any more
        docs = got
    return docs
