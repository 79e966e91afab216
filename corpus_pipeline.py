"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the
columns of ``documents``. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtables.llm import decontaminate, jaccard, mixing, sharding, toxicity
from webtables.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join."""
    return jaccard.unique_documents(docs)


def drop_benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mix_documents(docs, mixing.cycle(5, 2, 1))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return sharding.shard_documents(docs, shards=16).select(*docs.columns, "size", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_overlap),
    ("mixing_sources", mix),
    ("sharding", shard),
]

# trained scores and similarity joins have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass all stages, with size, shard and slot.

    Null texts count as empty; texts without words are no copies of each other; null ids and sources are values. Rows
    that repeat id and text are one document. Tables without rows give no rows, without labels no document is toxic, and
    without a benchmark none is contaminated. Further columns of ``documents`` are carried, whatever they are called.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
