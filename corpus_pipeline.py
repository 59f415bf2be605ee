"""The document pipeline: quality rules, language identification, near-duplicates, secrets, packing.

Each stage takes what its predecessor kept, as written and read back; all but the last return the columns of documents.
Null and empty texts fail the quality rules (fewer than 50 words). Null languages and sources add no evidence; null ids are
kept as they are, repeated rows leave one. Very long texts are worked on whole, alone in their slice. Empty tables pass
through all stages and give no rows; other columns, whatever their names, are carried to the last stage. ``run`` removes
a stage's intermediate tables once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm import language, near_dup, packing, quality, secrets
from sitelode.llm.common import mark, release, shared_path, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the counts or the classifier, which is fitted on the labelled ones among them."""
    model = quality.fit(quality.labelled_features(docs, table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a likely language."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    return near_dup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mask; the documents stay."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The classifiers have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), name, path=path)
        release(spark, before, keep=(path,))  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
