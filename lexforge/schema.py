"""The unified article and claim table, its vocabularies, and validation by rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and label vocabularies of the unified schema.
COLUMNS = ["id", "title", "text", "label", "label5", "label3", "source_dataset", "date", "split", "meta"]
SIX_TO_FIVE = {"true": "REAL", "mostly-true": "REAL", "half-true": "PARTIALLY TRUE", "barely-true": "MISLEADING", "false": "FAKE", "pants-fire": "FAKE"}
SIX_TO_THREE = {"true": "TRUE", "mostly-true": "TRUE", "half-true": "MIXED", "barely-true": "MIXED", "false": "FALSE", "pants-fire": "FALSE"}
BINARY_TO_FIVE = {"real": "REAL", "fake": "FAKE"}
BINARY_TO_THREE = {"real": "TRUE", "fake": "FALSE"}
STANCES = {"SUPPORTS": "SUPPORTS", "REFUTES": "REFUTES", "NOT ENOUGH INFO": "NEUTRAL"}
VERDICTS = ["REAL", "FAKE", "MISLEADING", "PARTIALLY TRUE", "UNVERIFIABLE"]

UNIFIED = T.StructType([T.StructField(c, T.StringType(), c != "id") for c in COLUMNS])


def mapped(column: Column, table: dict[str, str]) -> Column:
    """A closed dictionary as an expression; unmapped values become null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, column)


def align(df: DataFrame) -> DataFrame:
    """The ten string columns in order; missing ones are null, others go."""
    return df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def violations(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(rule, key) for every row that breaks a rule; a rule is true where a row is right. One pass, no driver loop over rows."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(rule, key) of values that occur more than once."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"unique_{column}").alias("rule"), F.col(column).cast("string").alias("key"))


class InvalidRows(ValueError):
    """Raised with the broken rules and how many rows break each."""


def require(found: DataFrame) -> None:
    """Raises InvalidRows unless found, a frame of (rule, key), is empty."""
    counts = {r["rule"]: r["n"] for r in found.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    if counts:
        raise InvalidRows(counts)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)
