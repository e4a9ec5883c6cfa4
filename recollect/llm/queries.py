"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hamming, html_extract, lm, neardup, pieces, pii, quality, repair, tokencount
from .tables import read


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(read(spark, sf_dir, "embeddings"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_near_copies": op2_near_copies,
    "op3_personal_data": op3_personal_data,
    "op4_token_counts": op4_token_counts,
    "op5_main_text": op5_main_text,
    "op6_quality": op6_quality,
    "op7_leaks": op7_leaks,
    "op8_hamming_top_k": op8_hamming_top_k,
    "op9_pieces": op9_pieces,
    "op10_token_files": op10_token_files,
}

ORACLE: dict[str, str] = {"op8_hamming_top_k": hamming.ORACLE}
