"""A corpus pipeline over `documents`: each stage filters or trims what the stage before it kept.

All stages but the last return the columns of documents, whatever their names. Null and empty texts have no words: they
are never toxic by the lexicon, are near copies of each other (one stays), and are taken zero times by the mix. Rows
are told apart by (doc_id, text), null doc_ids first; fully equal rows are one document and one of them stays from the
second stage on. An empty table gives an empty result. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lontar.llm import decontaminate, mixing, simhash, substrings, toxicity
from lontar.llm.common import delete, scratch, table, tune


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, learned from the labelled rows among docs, rejects go."""
    tune(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of least doc_id."""
    tune(spark)
    return simhash.unique(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier in the corpus go from the text; texts without words left go."""
    tune(spark)
    return substrings.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a window with a benchmark item go."""
    tune(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the mix of what is left."""
    tune(spark)
    return mixing.mix(docs.select("doc_id", "source", "text")).selectExpr("doc_id", "source", "_size AS size", "_source_size AS source_size", "_target AS target", "_taken AS taken")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("substrings", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: A learned model and 64-bit fingerprints are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
