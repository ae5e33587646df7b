"""The corpus pipeline: language, exact copies, near copies, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonefield.llm import exact_dedup, langid, mixing, ngram_join, sentencepiece_codec
from tonefield.llm.shared import stored, table

#: The mix cannot be told in SQL: its chances come from hashes that are paired level by level.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what lies too far from every centroid goes."""
    return langid.identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its runs of five words."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    return sentencepiece_codec.encoded(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
