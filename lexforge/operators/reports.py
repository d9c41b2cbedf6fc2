"""Reports: agreement of two labellers, latency and versions of runs, the surest mistakes, a summary of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.operators import orderstats as O
from lexforge.schema import require, violations
from lexforge.storage import materialize


def agreement(gold: DataFrame, second: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(kind, name, value, ids) of gold (id, label) and second (id, label2): n used, raw agreement and kappa; each class's agreement; who is left out
    for want of a readable label; who disagrees, by pair of labels. A second label that isn't known raises.
    """
    label2 = F.upper(F.trim(F.coalesce("label2", F.lit(""))))
    own = gold.join(second.select("id", label2.alias("label2")), "id")
    require(violations(own, {"known_label2": F.col("label2").isin([*labels, "", "UNREADABLE"])}))
    own = materialize(own.select("id", "label", F.when(F.col("label2").isin(list(labels)), F.col("label2")).alias("label2")))
    used = own.filter("label2 IS NOT NULL")
    names = own.sparkSession.createDataFrame([(x,) for x in labels], "name string")
    sides = used.select(F.explode(F.array(F.struct(F.col("label").alias("name"), F.lit(1).alias("a"), F.lit(0).alias("b"), (F.col("label") == F.col("label2")).cast("int").alias("h")), F.struct(F.col("label2").alias("name"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("h")))).alias("x"))
    counts = materialize(names.join(sides.select("x.*").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("h").alias("h")), "name", "left").na.fill(0))
    total = counts.agg(F.sum("a").cast("double").alias("n"), (F.sum("h") / F.sum("a")).alias("raw"), (F.sum(F.col("a") * F.col("b")) / (F.sum("a") * F.sum("a"))).alias("e"))
    none = F.lit(None).cast("string")
    lines = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("used", F.col("n")), ("raw", F.col("raw")), ("kappa", F.try_divide(F.col("raw") - F.col("e"), 1 - F.col("e"))))]))
    summary = total.select(lines.alias("x")).select(F.lit("summary").alias("kind"), "x.name", "x.value", none.alias("ids"))
    classes = counts.select(F.lit("class").alias("kind"), "name", F.try_divide(2 * F.col("h"), F.col("a") + F.col("b")).alias("value"), none.alias("ids"))
    listed = F.array_join(F.array_sort(F.collect_list("id")), ",")  # lists of labellers, which people write
    out = own.filter("label2 IS NULL").agg(F.count("*").cast("double").alias("value"), listed.alias("ids")).select(F.lit("excluded").alias("kind"), none.alias("name"), "value", F.when(F.col("value") > 0, F.col("ids")).alias("ids"))
    differ = used.filter("label <> label2").groupBy(F.concat_ws(" / ", "label", "label2").alias("name")).agg(F.count("*").cast("double").alias("value"), listed.alias("ids"))
    return summary.unionByName(classes).unionByName(out).unionByName(differ.select(F.lit("disagreement").alias("kind"), "name", "value", "ids"))


def run_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """(version, mode, n, median_ms, p90_ms, warm, faster, missing) of two versions of runs (id, mode, wall_ms, misses): warm is the share of runs without a
    miss; faster and missing count runs of the first version that the second does faster, or lacks.
    """
    both = materialize(first.withColumn("version", F.lit("v1")).unionByName(second.withColumn("version", F.lit("v2"))))
    times = O.quantiles(both, ["version", "mode"], F.col("wall_ms"), [0.5, 0.9])
    warm = both.groupBy("version", "mode").agg(F.round(F.avg((F.col("misses") == 0).cast("double")), 6).alias("warm"))
    other = both.filter("version = 'v2'").select("id", "mode", F.col("wall_ms").alias("later"))
    change = both.filter("version = 'v1'").join(other, ["id", "mode"], "left").groupBy("mode").agg(F.count_if(F.col("later") < F.col("wall_ms")).alias("faster"), F.count_if(F.col("later").isNull()).alias("missing"))
    out = times.join(warm, ["version", "mode"]).join(F.broadcast(change), "mode")  # a row for each mode
    return out.select("version", "mode", "n", F.round(F.get("q", F.lit(0)), 4).alias("median_ms"), F.round(F.get("q", F.lit(1)), 4).alias("p90_ms"), "warm", "faster", "missing")


def top_errors(scored: DataFrame, key: str, gold: str, p_fake: str, k: int) -> DataFrame:
    """(gold, pred, rank, key, p): the k mistakes of the surest scores in either direction, of equals the first by key."""
    pred = F.when(F.col(p_fake) >= 0.5, "fake").otherwise("real")
    wrong = scored.select(F.col(gold).alias("gold"), pred.alias("pred"), key, F.col(p_fake).alias("p")).filter("gold <> pred")
    order = W.Window.partitionBy("gold").orderBy(F.round(F.abs(F.col("p") - 0.5), 6).desc(), key)  # the limit is taken before the exchange
    return wrong.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("gold", "pred", F.col("rank").cast("long").alias("rank"), key, "p")


def summary(df: DataFrame, label: str, source: str, length: str) -> DataFrame:
    """(figure, name, value): rows, shares, lengths and sources by class, and how many sources have one class only."""
    own = materialize(df.select(F.col(label).alias("name"), F.col(source).alias("source"), F.col(length).alias("n")))
    total = own.agg(F.count("*").cast("double").alias("all"))
    by = own.groupBy("name").agg(F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("mean length"))
    pairs = own.select("name", "source").distinct()
    shares = by.crossJoin(total).select("name", F.round(F.col("rows") / F.col("all"), 6).alias("share"), "mean length")  # a row for each class
    medians = O.quantiles(own, ["name"], F.col("n"), [0.5]).select(F.lit("median length").alias("figure"), "name", F.round(F.get("q", F.lit(0)), 6).alias("value"))
    lines = shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), "name", F.col(f"`{c}`").alias("value")) for c in ("share", "mean length")])).alias("x")).select("x.*")
    sources = pairs.groupBy("name").agg(F.count("*").cast("double").alias("value")).select(F.lit("sources").alias("figure"), "name", "value")
    single = pairs.groupBy("source").agg(F.count("*").alias("c")).filter("c = 1").agg(F.count("*").cast("double").alias("value")).select(F.lit("single-class sources").alias("figure"), F.lit("all").alias("name"), "value")
    rows = total.select(F.lit("rows").alias("figure"), F.lit("all").alias("name"), F.col("all").alias("value"))
    return rows.unionByName(lines).unionByName(medians).unionByName(sources).unionByName(single)
