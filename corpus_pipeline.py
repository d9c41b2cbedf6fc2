"""From raw documents to packed training batches: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; n_chars follows a changed text. There is no oracle: optimal buckets and shard order are not SQL, so tests
hold the result against a brute-force version.

Defined cases, in every stage: a null or empty text fails the quality rules and goes there; a stage that gets one all the same
keeps it as it is (null stays null). Null keys are kept; of a group of near copies the rows of its least key stay, and a group
of null keys alone stays whole. Repeated rows are judged alike; as a group of near copies under one key they stay together.
Very long texts are worked on whole. Empty tables give empty tables, and further columns, whatever their names, stay as they
are up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import jaccard, quality, queries, secrets, substring
from lexforge.llm.common import discard, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.apply_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur earlier are cut out of the texts."""
    return _resized(substring.apply_dedup(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _resized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, in pieces, length buckets and batches. A text that lost all its words has a piece of none."""
    return queries.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return kept
        before, docs = docs, materialize(kept)
        if k:
            discard(before)
    return docs
