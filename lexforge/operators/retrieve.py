"""Retrieval: vector search, evidence ranking, leakage guard, greedy vector dedup, sentence selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions import vectors as V
from lexforge.functions.urls import norm_url

BLOCK = 8192


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(ids, m, width): unit vectors of up to BLOCK rows as one matrix; a block's rows are those of one batch and one width."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                lists = b.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                for width in np.unique(sizes):
                    own = pa.array(np.flatnonzero(sizes == width))
                    m = lists.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), int(width))
                    m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
                    ids = b.column(0).take(own)
                    out = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids), pa.array([m.tobytes()], pa.binary()), pa.array([int(width)], pa.int32())]
                    yield pa.RecordBatch.from_arrays(out, ["ids", "m", "width"])

    return df.select(key, vector).mapInArrow(run, f"ids array<{kind}>, m binary, width int")


def vector_topk(index: DataFrame, queries: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """(query_id, record_id, cosine, rank): the k best records of each query, cut at least afterwards, so fewer may be left.

    index: (record_id, embedding), queries: (query_id, embedding), a stated set. Both are packed in blocks, every query block
    meets every record block, as a product of two matrices, and a pair of blocks leaves k rows a query; the best of these
    are ranked by query. Spark copies the query blocks to all tasks only if they are small enough to be broadcast.
    """
    qk, rk = queries.schema["query_id"].dataType.simpleString(), index.schema["record_id"].dataType.simpleString()
    left = _packed(index, "record_id", "embedding")
    right = _packed(queries, "query_id", "embedding").withColumnsRenamed({"ids": "q_ids", "m": "q", "width": "q_width"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                width = b.column(2)[x].as_py()
                records, asked = b.column(0)[x].values, b.column(3)[x].values
                r, q = (np.frombuffer(b.column(c)[x].as_buffer(), np.float64).reshape(-1, width) if width else np.zeros((len(own), 1)) for c, own in ((1, records), (4, asked)))
                order = pc.sort_indices(records).to_numpy()
                for at in range(0, len(q), 256):
                    scores = np.round(q[at : at + 256] @ r.T, 6)[:, order]
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # of equals the first by id
                    rows = np.repeat(np.arange(at, at + len(scores)), best.shape[1])
                    out = [asked.take(pa.array(rows)), records.take(pa.array(order[best.ravel()])), pa.array(np.take_along_axis(scores, best, 1).ravel())]
                    yield pa.RecordBatch.from_arrays(out, ["query_id", "record_id", "cosine"])

    pairs = left.crossJoin(right).filter("width = q_width").select("ids", "m", "width", "q_ids", "q")  # of blocks
    scored = pairs.mapInArrow(run, f"query_id {qk}, record_id {rk}, cosine double")
    order = W.Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "record_id")
    out = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out if least is None else out.filter(F.col("cosine") >= least)


def rank_evidence(evidence: DataFrame, keys: list[str], order: str, limit: int = 10) -> DataFrame:
    """The best items of each claim by cosine times weight; items without weight go; of equals the first by order."""
    by = W.Window.partitionBy(*keys).orderBy((F.col("cosine") * F.col("w")).desc(), order)
    return evidence.filter(F.col("w") > 0).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def leakage_guard(evidence: DataFrame, excluded: DataFrame, url: str = "url", canonical: str = "canonical") -> DataFrame:
    """evidence with leaked: its URL or canonical URL is excluded, in normal form. Kept rows and the audit are its two halves."""
    keys = excluded.select(norm_url(F.col(url)).alias("u")).distinct()
    own = evidence.withColumn("__u", norm_url(F.col(url))).withColumn("__c", norm_url(F.col(canonical)))
    one = own.join(keys.select(F.col("u").alias("__u"), F.lit(True).alias("__a")), "__u", "left")
    two = one.join(keys.select(F.col("u").alias("__c"), F.lit(True).alias("__b")), "__c", "left")
    return two.withColumn("leaked", F.coalesce(F.col("__a"), F.col("__b"), F.lit(False))).drop("__u", "__c", "__a", "__b")


def greedy_dedupe(candidates: Column, most: float = 0.85, limit: int | None = None) -> Column:
    """Of an array of structs with a unit vector v, in order, those whose cosine to every kept one is at most most. Meant for some dozen items."""
    def step(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda y: V.dot(y.getField("v"), x.getField("v")) > most)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    out = F.aggregate(candidates, F.slice(candidates, 1, 0), step)
    return out if limit is None else F.slice(out, 1, limit)


def best_sentences(scored: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, passage, top): the k best of (key, pos, sentence, sim), joined in document order, and the best score."""
    order = W.Window.partitionBy(key).orderBy(F.col("sim").desc(), "pos")
    kept = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x.getField("sentence")), " ").alias("passage"), F.max("sim").alias("top"))
