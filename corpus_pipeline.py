"""A corpus pipeline of five stages, each of them one operator of the llm subpackage.

Each stage gets what the one before kept, as Parquet, and returns the columns of ``documents`` but for the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.exact_dedup import drop_copies
from roadloom.llm.packing import best_fit_packing
from roadloom.llm.quality_classifier import drop_low_quality
from roadloom.llm.quality_rules import drop_rejected
from roadloom.llm.queries import held_out, table
from roadloom.llm.simhash import drop_near_copies
from roadloom.session import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 0 go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), held_out())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule go."""
    return drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by close fingerprints the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_pack),
]

#: SQL can express neither the fitted classifier nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
