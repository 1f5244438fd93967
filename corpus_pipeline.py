"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm.decontamination import clean_rows
from eventlake.llm.exact_dedup import dedup_rows
from eventlake.llm.jaccard_join import one_of_each
from eventlake.llm.language_id import accepted_rows, train
from eventlake.llm.packing import pack
from eventlake.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language fits, those without a letter among them. Learns from the documents that name their language."""
    return accepted_rows(docs, train(docs.select("doc_id", "text", "lang")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return dedup_rows(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return one_of_each(spark, docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return clean_rows(spark, docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in training sequences: doc_id, piece, n_tokens, bin_id, capacity, place."""
    return pack(spark, docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", packed),
]

#: Stages that learn, keep state or pack can't be told in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(spark, docs, f"stage{i}")
    return docs
