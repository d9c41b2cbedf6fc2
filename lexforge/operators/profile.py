"""Profiling of labelled corpora: lengths, terms by class, vocabularies, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions import text as X
from lexforge.operators import orderstats as O

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def describe(df: DataFrame, value: Column, by: str) -> DataFrame:
    """by, n, mean, percentiles as p05..p99, interpolated, all from counts of values; no group's values are held."""
    own = df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    found = O.quantiles(df, [by], value, PERCENTILES).select(F.col(by).alias("__by"), "q")
    joined = own.join(found, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.select(by, "n", "mean", *[F.round(F.get("q", F.lit(k)), 6).alias(f"p{round(100 * q):02d}") for k, q in enumerate(PERCENTILES)])


def class_doc_freq(df: DataFrame, key: str, label: str, text: str = "text", min_df: int = 1) -> DataFrame:
    """(term, label, tf, df) of words without function words."""
    words = X.let(X.without_stopwords(X.word_tokens(F.col(text))), lambda w: w)
    tokens = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.explode(words).alias("term"))
    per_doc = tokens.groupBy("key", "label", "term").agg(F.count("*").alias("c"))
    return per_doc.groupBy("term", "label").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).filter(F.col("df") >= min_df)


def class_ratio(freq: DataFrame, a: str, b: str, eps: float = 0.5) -> DataFrame:
    """(term, df_a, df_b, log2_ratio) with smoothing."""
    own = freq.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("df"))), F.lit(0)).alias(f"df_{n}") for x, n in ((a, "a"), (b, "b"))])
    return own.withColumn("log2_ratio", F.round(F.log2((F.col("df_a") + eps) / (F.col("df_b") + eps)), 6))


def top_ngrams(df: DataFrame, label: str, n: int, k: int, text: str = "text") -> DataFrame:
    """(label, gram, n): the k most common n-grams of each class; function words go before n-grams are formed."""
    grams = X.let(X.without_stopwords(X.word_tokens(F.col(text))), lambda w: X.ngrams(w, n))
    counts = df.select(F.col(label).alias("label"), F.explode(grams).alias("gram")).groupBy("label", "gram").agg(F.count("*").alias("n"))
    order = W.Window.partitionBy("label").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def vocabulary_overlap(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """(n_common, n_union, jaccard) of the top terms of two frames (term, n)."""
    best = lambda d: d.orderBy(F.col("n").desc(), "term").limit(top).select("term")
    x, y = best(a).withColumn("a", F.lit(1)), best(b).withColumn("b", F.lit(1))
    return x.join(y, "term", "full").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_common"), F.count("*").alias("n_union")).withColumn("jaccard", F.round(F.col("n_common") / F.col("n_union"), 6))


def oov_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tokens, oov, rate): the share of b's tokens whose term a lacks."""
    marked = b.join(a.select("term", F.lit(1).alias("known")), "term", "left")
    return marked.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("oov")).withColumn("rate", F.round(F.col("oov") / F.col("tokens"), 6))


def term_totals(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(X.word_tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def fit_share(df: DataFrame, n: Column, limits: list[int]) -> DataFrame:
    """(max_len, fits, kept): the share of rows no longer than a limit, and the median share of a row that is kept."""
    counts = df.select(n.alias("n")).filter("n > 0").groupBy("n").agg(F.count("*").alias("c"))
    rows = counts.withColumn("max_len", F.explode(F.array(*map(F.lit, limits))))
    fits = rows.groupBy("max_len").agg(F.round(F.sum(F.when(F.col("n") <= F.col("max_len"), F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("fits"))
    each = df.select(n.alias("n"), F.explode(F.array(*map(F.lit, limits))).alias("max_len")).filter("n > 0")
    kept = O.quantiles(each, ["max_len"], F.least("max_len", "n") / F.col("n"), [0.5])
    return fits.join(kept, "max_len").select("max_len", "fits", F.round(F.get("q", F.lit(0)), 6).alias("kept"))


def ecdf(df: DataFrame, value: Column) -> DataFrame:
    """(value, n, share): the share of rows up to each distinct value."""
    ranks = O.value_ranks(df, [], value)
    return ranks.select("value", "n", F.round((F.col("before") + F.col("n")) / F.col("total"), 6).alias("share"))


def histogram(df: DataFrame, value: Column, width: int, most: int, by: str) -> DataFrame:
    return df.groupBy(by, (F.floor(F.least(value, F.lit(most)) / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with margins as null."""
    return df.cube(a, b).agg(F.count("*").alias("n"))
