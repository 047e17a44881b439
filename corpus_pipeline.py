"""From documents to packed training sequences, in stages that each write their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabspark.functions.scratch import materialise, release
from tabspark.llm import near_copies, packing, pii, quality, toxicity
from tabspark.llm.common import table
from tabspark.llm.queries import BYTE_BPE


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic passages."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return near_copies.keep_one(docs)


def private_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return pii.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids with the pieces of documents they hold."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", good_documents),
    ("toxicity", clean_documents),
    ("near duplicates", single_documents),
    ("private data", private_removed),
    ("packing", packed_sequences),
]
# Models and tokenizers have no form in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and reread.

    A stage's table goes when the next one is written; the last one's input stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if i:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
