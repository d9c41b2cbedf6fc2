"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.storage import delete_path, discard, materialize, parts_for, scratch, shared_dir

__all__ = ["WORD", "delete_path", "discard", "let", "materialize", "parts_for", "scratch", "shared_dir", "slices", "table"]

#: A word: a run of anything but ASCII white space. Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row.

    The optimizer copies an expression into a lambda that refers to it, where it would be computed
    again for every array element; an element of a one-element array is bound once.
    """
    return F.transform(F.array(value), body).getItem(0)


def slices(sizes, limit: int):
    """(first, end) of consecutive items whose sizes sum to limit at most, or single items beyond it."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size > limit:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
