"""Exact order statistics of groups of any size: counts by value, running sums in parts of a range, selection by rank.

Values are counted first, combined before the exchange, so that ties cost nothing. The counts are dealt by range of (keys, value) and
written; running sums inside each part are offset by those of the parts before it. A key with most of the rows spans many parts, and no task
or array holds a group. Rows without a value take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.storage import materialize


def value_ranks(df: DataFrame, keys: Sequence[str], value: Column, parts: int | None = None) -> DataFrame:
    """(keys..., value, n, before, total): how often each value occurs, how many rows of its key have a smaller one, and how many the key has in all."""
    counts = df.select(*keys, value.alias("value")).filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    order = [*map(F.col, keys), F.col("value")]
    dealt = counts.repartitionByRange(parts, *order) if parts else counts.repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("n").alias("s"))  # a row for each key, and one more for each border of parts
    earlier = W.Window.partitionBy(*keys).orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__offset"), F.sum("s").over(W.Window.partitionBy(*keys)).alias("total"))
    inside = W.Window.partitionBy(*keys, "__part").orderBy("value").rowsBetween(W.Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return summed.join(offsets, same).select(*keys, "value", "n", (F.col("__in") + F.col("__offset")).alias("before"), "total")


def _at(rank: Column) -> Column:
    """Aggregate: the value whose rows have the place rank, from 0, in their key's order."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], parts: int | None = None) -> DataFrame:
    """(keys..., n, q array<double>): quantiles between the two nearest ranks, interpolated."""
    place = [F.lit(q) * (F.col("total") - 1) for q in shares]
    sides = [c.alias(f"__{s}{k}") for k, p in enumerate(place) for s, c in (("l", _at(F.floor(p))), ("h", _at(F.ceil(p))))]
    own = value_ranks(df, keys, value, parts).groupBy(*keys).agg(F.max("total").alias("n"), *sides)
    part = [F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for q in shares]
    low, high = ([F.col(f"__{s}{k}").cast("double") for k in range(len(shares))] for s in "lh")
    return own.select(*keys, "n", F.array(*[x + (y - x) * p for x, y, p in zip(low, high, part, strict=True)]).alias("q"))


def median_low(df: DataFrame, keys: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """(keys..., value): the lower median of each key that has a value."""
    return value_ranks(df, keys, F.col(value), parts).groupBy(*keys).agg(_at(F.floor((F.col("total") - 1) / 2)).alias(value))
