"""Corpus pipeline: language ID, exact dedup, near-duplicate dedup, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``.  All stages but the last return the columns of ``documents``,
whatever they are called; only ``doc_id``, ``text``, ``lang`` and ``source`` are read.  Rows are
kept or dropped one by one, not by id.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoflow.llm import exact_dedup, jaccard_join, langid, mixing, packing
from isoflow.llm.common import discard_between, made, materialize, table

MIN_LANGUAGE_SHARE = 0.5
"""Documents whose best language holds less than this share of their words are rejected."""


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in which no language has half of the words.

    Null and empty texts have no letter and go.  Null ids, sources and languages do not matter
    (rows without a language are not learned from); repeated rows are judged alike.
    """
    return langid.confident(docs, langid.fit(docs), MIN_LANGUAGE_SHARE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts (A-Z lower-cased, null as empty): that of the largest id.

    Null ids come last; of several rows with the kept id one stays.  Other texts of a dropped
    row's id stay.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that of the smallest id, of each group linked by shingle similarity.

    Null ids come last, ties go by the text's hash, and of rows equal in both one stays.  Texts
    without words are linked with nothing and stay.
    """
    return jaccard_join.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as the mix of sources takes it.

    A null source is a source of its own.  Texts without words have size 0 and come as often as
    their source's rate says.  The coin hangs on the id: rows of one id, or of none, share it.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in packed sequences.

    A null text is one end token.  Copies that the mix emits are documents of their own; ids may
    repeat or be null.
    """
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after one another; what a stage leaves behind goes when its result is written."""
    docs, kept = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard_between(spark, kept, made() - 1)
        kept = made() - 1
    return docs
