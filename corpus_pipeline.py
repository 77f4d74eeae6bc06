"""The corpus pipeline: quality, near copies, repeats, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hackney.llm import bin_completion, cotraining, simhash_bktree, substring_dedup, wu_manber
from hackney.llm.scratch import stage, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are judged too."""
    return cotraining.keep_good(spark, docs, tables(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies; repeated rows and null texts are copies."""
    return simhash_bktree.keep_one(spark, docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over fifty words that other documents have too.

    Null, empty and short texts stay as they are; repeated rows lose what they share.
    """
    return substring_dedup.without_repeats(spark, docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts have none and stay."""
    return wu_manber.without_leaks(spark, docs, tables(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence."""
    return bin_completion.op8(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", leaks),
    ("best-fit packing", packing),
]
#: Classifiers, XXH64 and the tokenizer are beyond SQL; tests/llm/test_corpus.py
#: compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read by the next."""
    docs = tables(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
