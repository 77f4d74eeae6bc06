"""The operators as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bin_completion,
    cotraining,
    line_rules,
    link_trust,
    merkle_manifest,
    phrase_setm,
    pruned_graph,
    simhash_bktree,
    substring_dedup,
    token_frames,
    toxicity,
    warc_derive,
    wu_manber,
)
from .oracle import ORACLE
from .scratch import tables

__all__ = ["ORACLE", "QUERIES"]


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.op1(spark, tables(spark, sf_dir, "documents"))


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.op2(spark, tables(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op3(spark, tables(spark, sf_dir, "documents"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.op4(spark, tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.op5(tables(spark, sf_dir, "documents"))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bktree.op6(spark, tables(spark, sf_dir, "documents"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.op7(spark, tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.op8(spark, tables(spark, sf_dir, "documents"))


def op9_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.op9(spark, tables(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10(spark, tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.op11(spark, tables(spark, sf_dir, "embeddings"))


def op12_phrase_setm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_setm.op12(spark, tables(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.op13(spark, tables(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1_token_frames,
    "op2_link_trust": op2_link_trust,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_cotraining": op4_cotraining,
    "op5_line_rules": op5_line_rules,
    "op6_simhash_bktree": op6_simhash_bktree,
    "op7_wu_manber": op7_wu_manber,
    "op8_bin_completion": op8_bin_completion,
    "op9_warc_derive": op9_warc_derive,
    "op10_toxicity": op10_toxicity,
    "op11_pruned_graph": op11_pruned_graph,
    "op12_phrase_setm": op12_phrase_setm,
    "op13_merkle_manifest": op13_merkle_manifest,
}
