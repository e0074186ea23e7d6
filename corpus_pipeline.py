"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import jaccard_join, language_id, line_dedup, mixing, packing
from quaymark.llm.shared import discard, documents, written


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that fit their likeliest language far worse than its texts of their size do: no language, or none that was learned."""
    return language_id.with_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sources or more have stay in one document; no document goes."""
    return line_dedup.dedup_lines(docs, site="source", min_sites=10)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as their source's target weight asks for."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, window=1024)


STAGES = [("language ID", tell_language), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: SQL has no tokenizer; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written and read again as the next one's documents, and deleted when that is done."""
    docs, last = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
