"""The corpus pipeline: quality rules, near copies, repeated passages, personal data, packing.

Every stage reads the documents its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import ngram_join, packing, pii, quality, substring
from cohortloom.llm.common import fresh_name, stored
from cohortloom.session import ship_package, tuned


def _counted(docs: DataFrame) -> DataFrame:
    """The character count follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or that the trees reject go. The labels of the table folder train the trees."""
    ship_package(tuned(spark))
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep_good(docs, quality.train_on_labels(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked rows the one with the smallest id stays, one without an id before all others.

    Rows are told apart by numbers that are written down before anything depends on them: texts that share an id, or
    have none, are linked by their words alone. Rows without words are linked with nothing.
    """
    ship_package(tuned(spark))
    row = fresh_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_join.similar_documents(numbered.select(row, "text"), id_col=row)
    ids = numbered.select(F.col("doc_id").cast("bigint").alias("id"), F.col(row).alias("rid"))
    found = groups.select(F.col("doc_id").alias("rid"), "component_id").join(ids, "rid")
    first = found.groupBy("component_id").agg(F.min(F.struct("id", "rid")).alias("first")).select("first.rid")
    return numbered.join(first, numbered[row] == first["rid"], "left_semi").drop(row)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also stand earlier are taken out; texts that lose all words go."""
    ship_package(tuned(spark))
    return _counted(substring.without_repeats(docs, substring.repeat_runs(docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship_package(tuned(spark))
    return _counted(pii.without_personal_data(docs, pii.train_on_corpus(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of 2048 tokens, with their ids."""
    ship_package(tuned(spark))
    return packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("personal data", personal_data),
    ("packing", pack),
]

# Boosted trees and tokenizers have no SQL form: the tests hold run() against a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
