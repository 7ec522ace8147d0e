"""From raw documents to token files: language, near-duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents. Stages are judged on what their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clampspark.llm import decontaminate, lang, mixing, repair, similar
from clampspark.llm.queries import table, vocab
from clampspark.llm.text import small_batches
from clampspark.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, texts without a letter and undecided ones go."""
    small_batches(spark)
    return lang.accepted(docs, lang.train(docs, vocab("byte_bpe_multi_50k.tiktoken")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles: the smallest doc_id."""
    small_batches(spark)
    return similar.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them."""
    small_batches(spark)
    path = scratch_path(spark, "shards")
    repair.write(docs, path, vocab("byte_bpe_50k.json"))
    return repair.read(spark, path)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token_ids", token_ids)]

# Fingerprints, trained models and tokenizers have no SQL form; tests compare the operators of the stages, not run(), with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
