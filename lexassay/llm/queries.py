"""Queries of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexassay.sources.tables import table

from . import canonical, leakage, mixture, pairs, sentences, truncation

#: Ranks file of a public tokenizer on every node.
TOKENIZER = os.environ.get("LEXASSAY_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.same_looking_pairs(canonical.question_texts(table(spark, folder, "questions")))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.changed_forms(canonical.question_texts(table(spark, folder, "questions")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "questions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_responses(table(spark, folder, "questions"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return mixture.mixture(documents, mixture.plan(documents, table(spark, folder, "mix_targets"), TOKENIZER))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(spark, mixture.plan(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), TOKENIZER))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_documents(table(spark, folder, "documents"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_forms": p1_forms, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {}
