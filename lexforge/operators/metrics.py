"""Metrics of predictions as aggregations: a row for each class, none collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.storage import materialize


def confusion(df: DataFrame, labels: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(gold, pred, n) for all pairs of labels, zeros included."""
    names = df.sparkSession.createDataFrame([(g, p) for g in labels for p in labels], "gold string, pred string")
    cells = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("m"))
    return names.join(cells, (F.col("gold") == F.col("g")) & (F.col("pred") == F.col("p")), "left").select("gold", "pred", F.coalesce("m", F.lit(0)).alias("n"))


def class_report(df: DataFrame, labels: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, support, predicted, precision, recall, f1); absent classes count as 0."""
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    sides = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("t")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hits"))
    own = names.join(sums, "label", "left").na.fill(0, ["support", "predicted", "hits"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return own.select("label", "support", "predicted", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def summary(df: DataFrame, labels: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(n, accuracy, macro_precision, macro_recall, macro_f1): one row."""
    macro = class_report(df, labels, gold, pred).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    total = df.agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))
    return total.crossJoin(macro)  # one row each


def score_counts(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, pos, neg): counts of each distinct score; ties meet here."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg"))


def cumulative(counts: DataFrame, parts: int = 64) -> DataFrame:
    """counts with tp and fp: sums over all scores at least as high.

    Scores are dealt by range to parts; sums inside a part are offset by those of the parts above, so that no task holds all.
    The parts are written once, as their bounds are sampled and a lost task might deal otherwise.
    """
    dealt = materialize(counts.repartitionByRange(parts, F.col("score").desc()).withColumn("part", F.spark_partition_id()))
    tops = dealt.groupBy("part").agg(F.max("score").alias("top"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = W.Window.orderBy(F.col("top").desc()).rowsBetween(W.Window.unboundedPreceding, -1)  # parts rows
    offsets = tops.select("part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    inside = W.Window.partitionBy("part").orderBy(F.col("score").desc())
    return dealt.withColumn("tp_in", F.sum("pos").over(inside)).withColumn("fp_in", F.sum("neg").over(inside)).join(F.broadcast(offsets), "part").select("score", "pos", "neg", (F.col("tp_in") + F.col("p0")).alias("tp"), (F.col("fp_in") + F.col("n0")).alias("fp"))


def roc_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score."""
    counts = score_counts(df, score, positive)
    total = df.agg(F.sum(F.col(positive).cast("long")).alias("np"), F.sum(1 - F.col(positive).cast("long")).alias("nn"))
    return cumulative(counts).crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), "tp", "fp", F.try_divide(F.col("tp"), F.col("np")).alias("tpr"), F.try_divide(F.col("fp"), F.col("nn")).alias("fpr"))


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auc): pairs in the right order, ties as half."""
    c = cumulative(score_counts(df, score, positive))
    sums = c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * F.col("fp")).alias("beaten"), F.sum(F.col("pos") * F.col("neg")).alias("tied"))
    right = F.col("n_pos") * F.col("n_neg") - F.col("beaten") + F.lit(0.5) * F.col("tied")
    return sums.select("n_pos", "n_neg", F.try_divide(right, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa): one row."""
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("r")), cells.groupBy("b").agg(F.sum("n").alias("c"))
    expected = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("e"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return total.crossJoin(expected).select("n", po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def specific_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(label, agreement): twice the common cell over the sum of its row and column."""
    sides = df.select(F.explode(F.array(F.struct(F.col(a).cast("string").alias("label"), (F.col(a) == F.col(b)).cast("int").alias("same")), F.struct(F.col(b).cast("string").alias("label"), F.lit(0).alias("same")))).alias("x")).select("x.*")
    return sides.groupBy("label").agg((2 * F.sum("same") / F.count("*")).alias("agreement"))


def flag_metrics(df: DataFrame, gold: str, flag: str) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, accuracy) of a Boolean flag; null where undefined."""
    g, f = F.col(gold).cast("boolean"), F.col(flag).cast("boolean")
    sums = df.agg(F.count_if(g & f).alias("tp"), F.count_if(~g & f).alias("fp"), F.count_if(g & ~f).alias("fn"), F.count_if(~g & ~f).alias("tn"))
    d = lambda a, *b: F.try_divide(a, sum(b[1:], b[0]))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return sums.select("tp", "fp", "fn", "tn", d(tp, tp, fp).alias("precision"), d(tp, tp, fn).alias("recall"), d(tp + tn, tp, fp, fn, tn).alias("accuracy"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows over classes times the class's rows."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("all") / (F.col("k") * F.col("n")), 4).alias("weight"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """(label, share) of the most common class; of equals the first by name."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "label").limit(1).crossJoin(df.agg(F.count("*").alias("all"))).select("label", (F.col("n") / F.col("all")).alias("share"))
