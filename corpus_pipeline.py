"""A corpus from documents to packed sequences: language, near copies, secrets, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvida.llm import language_id, mixing, packing, secrets, simhash
from corvida.llm.common import Cut, read, scratch


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network tells with some confidence; `und` and doubtful ones go, so null and empty
    texts do. Rows with null or repeated ids are judged by their texts like others; repeated rows all stay or all go."""
    return language_id.keep_known(docs)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies; of rows that agree in id and text one. Texts
    without a word are copies of one another. Rows with a null id can't be told apart and all stay."""
    return simhash.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too; secrets in their texts are replaced by a mark. Null texts stay null."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains of the labels table to their target weights; a null text counts
    as an empty one. Without a labelled document of the kept domain every document stays."""
    return mixing.sample_mixture(docs, read(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens along the Hilbert curve; a null or empty text is one end id."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("simhash_near_dedup", first_of_near_copies),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models, iterated components and a vocabulary file are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole documents table; each one's rows are written and read again as the next one's.
    A stage's files are removed once the next one's rows are written; those of the last two stages stay, as the result
    reads them."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage cuts for itself goes with it
            rows = stage(spark, docs, sf_dir)
            made = Cut(rows, name, keep=True)
        if before is not None:
            before.drop()
        docs, before = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
