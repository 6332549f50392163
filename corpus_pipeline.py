"""A training corpus from raw documents: filter, deduplicate, mix, pack.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm.common import stage, unused_names
from helicase.llm.jaccard_join import first_of_each, jaccard_components
from helicase.llm.line_dedup import line_dedup, without_lines
from helicase.llm.mixing import mix_sources, repeat_documents
from helicase.llm.packing import pack_documents
from helicase.llm.quality_rules import keep_good, quality_rules

#: No SQL can express the stages.  ``tests/llm`` holds line numbers, groups, copies and pieces against brute force, and what stages keep against planted cases.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, quality_rules(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, however short; so do documents of which nothing is left."""
    n_lines, n_dropped = unused_names(docs, "n_lines", "n_dropped")
    left = without_lines(docs, line_dedup(docs, min_words=1), counts=(n_lines, n_dropped))
    emptied = (F.col(n_dropped) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    counted = {"n_chars": F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    return left.where(~emptied).select(*[counted[c].alias(c) if c in counted else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return first_of_each(docs, jaccard_components(docs, size=5, percent=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the wanted proportions: a document comes as often as the mix takes it."""
    return repeat_documents(docs, mix_sources(docs, weights=[5.0, 2.0, 1.0], budget=1.5, max_epochs=2.0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024, one row per piece."""
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mix_sources", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name=name)
    return docs
