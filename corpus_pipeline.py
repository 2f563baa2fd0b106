"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talktrace.llm import langid, mixing, packing, pii, simhash
from talktrace.llm.common import discard, short_batches, stored_at, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter go."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights; a document that it takes twice is there twice."""
    return mixing.mix(docs).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL has neither the hashes nor the tokenizer; tests compare stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written as Parquet and read again by the next stage.

    A result is deleted once the next one is written whole, so a run holds two copies of its corpus at most and leaves one, which
    the places of the last stage are read from. Texts go to Python in short batches.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES, 1):
        with short_batches(spark):
            docs = stage(spark, docs, sf_dir)
            stored = stored_at(docs) if number < len(STAGES) else None
        if stored is not None:
            docs, path = stored
            if before is not None:
                discard(spark, before)
            before = path
    return docs
