"""Documents to training windows: language, quality, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept.  In every stage null ids and
repeated rows are rows of their own, texts are read whole, extra columns go through untouched, whatever their names, and an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinspark.llm import decontaminate, langid, packing, simhash, weakquality
from kinspark.llm.common import forget, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter), or hardly like any learnt language, go; length is no matter."""
    return langid.keep_identified(docs, langid.fit_language_model(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for bad go; null and empty texts are judged by the score of a text without features."""
    return weakquality.keep_good(docs, weakquality.fit_quality_model(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the least id, null ids last, of equal ids the least text hash."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; one without words (null text) has no hits and stays."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into windows; a null text has the end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("window_packing", window_packing),
]

#: SQL can express neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, made = docs, stage(spark, docs, sf_dir)
        docs = stored(made, name)
        forget(made, before)  # the result reads nothing of the stages before
    return docs
