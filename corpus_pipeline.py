"""The training-data pipeline over `documents`: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, exact, mixing, neardup, repetition
from marginalia.llm.common import table, written

#: Bytes of a string that the passages stage removes where it is found elsewhere: shorter than 51 words of four
#: bytes with their spaces, so that a passage of over 50 words that repeats goes.
PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: so do those with a null or empty text. Rows that repeat are judged alike,
    and an empty table stays empty. All columns stay, whatever their names, here and in the stages that follow."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id, a null last; of rows that repeat one.
    Texts that are null or have no word are no duplicates and all stay."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of `PASSAGE_BYTES` bytes that are found elsewhere go from the texts, all places of them, and n_chars follows.
    A null text stays null; shorter texts stay as they are."""
    return exact.without_repeats(docs, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come once for each time that the mix takes them, at most twice, and not at all if it doesn't.
    A null source is a source of its own; a text without words, null or empty, stays once."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids in a further column; a null or empty text has none."""
    return bpe.encode(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: Minimum hashes, suffix arrays and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
