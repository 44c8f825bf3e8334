"""Queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rillsum.llm import ans, fuzzylines, langid, mixing, packing, rules, shards, simhash, toxicity, vafile
from rillsum.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, d: str) -> DataFrame:
    return ans.digest(spark, table(spark, d, "documents"), tokenizer("byte_bpe_50k.json"), specials=True)


def op2(spark: SparkSession, d: str) -> DataFrame:
    return shards.digest(spark, table(spark, d, "documents"))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return vafile.search(table(spark, d, "embeddings"), every=50, k=5)


def op4(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels"))


def op5(spark: SparkSession, d: str) -> DataFrame:
    return rules.assess(table(spark, d, "documents"), table(spark, d, "labels"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    return simhash.digest(table(spark, d, "documents"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    return fuzzylines.digest(table(spark, d, "documents"))


def op8(spark: SparkSession, d: str) -> DataFrame:
    return packing.digest(table(spark, d, "documents"), tokenizer("word_bpe_49k.json"), specials=True)


def op10(spark: SparkSession, d: str) -> DataFrame:
    return langid.digest(table(spark, d, "documents"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    return mixing.digest(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rans_tokens": op1, "op2_external_shuffle": op2, "op3_vafile_topk": op3, "op4_toxicity_bigru": op4, "op5_decision_list": op5, "op6_simhash_mih": op6,
        "op7_fuzzy_lines": op7, "op8_grouping_ga": op8, "op9_pivotal_mix": op9, "op10_rank_profiles": op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {"op3_vafile_topk": vafile.oracle(), "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in known.items() if v}
