"""A training corpus from ``documents``: four filters and a mix, each over all that the one before kept.

In every stage rows with null or empty texts are texts without words, null ids are kept apart, rows alike in id and text
share their fate but for ``near_duplicates``, which keeps one of them, very long texts are taken whole, other columns
(whatever their names) pass through, and an empty table gives an empty one. Ties are settled in each operator's
docstring. A text without words is judged by ``quality`` like any other; all that pass it are one group of
``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import read_table, scratch_folder
from textloom.llm.decontaminate import drop_leaks
from textloom.llm.line_dedup import without_repeated_lines
from textloom.llm.mixing import mix_sources
from textloom.llm.near_dedup import near_dedup
from textloom.llm.quality_classifier import filter_quality
from textloom.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return filter_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out but for their first occurrence; a document left without a word by that goes."""
    ship_package(spark)
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    ship_package(spark)
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and very short items are no evidence."""
    ship_package(spark)
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    ship_package(spark)
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages train a classifier, hash and align, which SQL can't express; tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read again."""
    folder = scratch_folder(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
