"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import table
from .decontaminate import decontaminate
from .near_dedup import near_dedup
from .perspectives import perspectives, rendered
from .piece_codec import piece_codec
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BPE)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec(table(spark, sf_dir, "documents"), PIECES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), language="lang")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), BPE))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rendered(perspectives(table(spark, sf_dir, "conversations")))
    pairs = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))
    return views.withColumn("mask", F.array_join(pairs, ","))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (
        op1_token_counts,
        op2_piece_codec,
        op3_quality_rules,
        op4_suffix_dedup,
        op5_secret_scan,
        op6_near_dedup,
        op7_token_files,
        op8_substring_dedup,
        op9_perspectives,
        op10_decontaminate,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op3_quality_rules": oracles.QUALITY_RULES,
        "op6_near_dedup": oracles.NEAR_DEDUP,
        "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op9_perspectives": oracles.PERSPECTIVES,
        "op10_decontaminate": oracles.DECONTAMINATE,
    }
