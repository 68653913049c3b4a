"""From raw documents to a token file: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import decontaminate, mixing, quality, simhash, tokens
from veridoc.sources import scratch
from veridoc.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts; it learns from the labelled ones among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Offsets, counts and checksums of the documents' ids in the token files."""
    return tokens.token_files(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: A trained network and SimHash have no counterpart in SQL. A test holds all five stages against plain loops, given the network's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again.

    Null and empty texts count as texts without words. Rows that repeat are copies: one is kept. Empty tables go through all
    stages. Other columns of ``documents`` are carried along to the mix.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
