"""The operators over their whole tables, with production parameters, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvida.llm import byte_bpe, chat_format, hnsw_dedup, language_id, mixing, packing, periodic_runs, quality_classifier, quality_rules, secrets, simhash, vector_codes, warc
from corvida.llm.common import read


def op1_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.isolate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_hnsw_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(read(spark, sf_dir, "pages"))


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(read(spark, sf_dir, "conversations"))


def op11_block_convolution_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(read(spark, sf_dir, "documents"))


def op12_scanned_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"))


def op13_bounded_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_isolation_forest_rules, op2_hnsw_near_vectors, op3_soft_membership_mixing, op4_simhash_gray_index, op5_byte_cnn_language,
        op6_randomness_secrets, op7_warc_derivatives, op8_hilbert_packing, op9_random_indexing_quality, op10_chat_perspectives,
        op11_block_convolution_runs, op12_scanned_byte_bpe, op13_bounded_vector_codes,
    )
}
ORACLES: dict[str, str] = {"op10_chat_perspectives": chat_format.ORACLE, "op13_bounded_vector_codes": vector_codes.ORACLE}
