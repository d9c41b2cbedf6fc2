"""An index of vectors: lists around centres, kept as Parquet partitions with their build's description; probes by bound, exact scores.

build() normalises the vectors and fits the centres by Spark's k-means on SAMPLE rows at most, which are drawn by a hash of their key; every row is then
filed in the list of its nearest centre. A list of over PART rows is dealt in parts by a hash of the key, so that none is one task, whatever
the data. search() looks into the lists whose centres are nearest to the query (PROBES). With exact=True it then looks into all further lists
that could hold a better row than the k-th so far: a cosine with a row of a list is at most that with the centre plus the list's radius. Scores are
cosines to the 6th place; of equals the least key comes first. Lists that no query asks for are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.storage import discard, materialize, shared_dir

SAMPLE, LISTS_MOST, PART, CHUNK, PROBES, SEED = 100_000, 4096, 65_536, 4096, 8, 42


@dataclass
class BuildInfo:
    """What an index was built of."""

    rows: int
    dims: int
    lists: int
    sampled: int
    seed: int
    key_type: str
    spark: str


@dataclass
class Index:
    info: BuildInfo
    vectors: DataFrame  # (record_id, v, list, part)
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers of one length as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _unit(df: DataFrame, key: str, vector: str, name: str, out: str) -> DataFrame:
    """(name, out) of the rows with a finite vector, of length one."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(key).alias(name), F.col(vector).alias("x"), length.alias("l")).filter("x IS NOT NULL AND size(x) > 0 AND l IS NOT NULL AND NOT isnan(l) AND l < double('infinity')")
    return rows.select(name, F.transform("x", lambda x: x.cast("double") / F.greatest("l", F.lit(1e-12))).alias(out))


def build(df: DataFrame, path: str, key: str = "record_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = SEED) -> BuildInfo:
    """An index of df's vectors, all of one length, in a folder. Rows without a key or a finite vector are left out."""
    spark = df.sparkSession
    rows = materialize(_unit(df, key, vector, "record_id", "v").filter("record_id IS NOT NULL"))
    n, dims, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if dims != most:
        raise ValueError(f"vectors of {dims} and of {most} numbers")
    n_lists = max(1, min(lists or ceil(sqrt(n or 1)), LISTS_MOST, n or 1))
    drawn = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    fitted = KMeans(k=n_lists, seed=seed, maxIter=10).fit(drawn.select(array_to_vector("v").alias("features"))) if n else None
    centres = np.array(fitted.clusterCenters()) if fitted else np.zeros((0, 1))  # LISTS_MOST at most
    held = spark.sparkContext.broadcast(centres)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, c = _matrix(b.column(1)), held.value
            place = ((c * c).sum(1) - 2 * v @ c.T).argmin(1) if len(v) else np.empty(0, np.int64)
            apart = np.sqrt(((v - c[place]) ** 2).sum(1)) if len(v) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place, pa.int32()), pa.array(apart)], ["record_id", "v", "list", "apart"])

    kind = rows.schema["record_id"].dataType.simpleString()
    filed = materialize(rows.mapInArrow(file, f"record_id {kind}, v array<double>, list int, apart double"))
    size = {r["list"]: r for r in filed.groupBy("list").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # a row for each list
    parts = {k: ceil(r["n"] / PART) for k, r in size.items()}
    known = spark.createDataFrame([(k, p) for k, p in parts.items()], "list int, parts int")
    dealt = filed.join(F.broadcast(known), "list").withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int"))
    dealt.select("record_id", "v", "part", "list").repartition("list", "part").write.partitionBy("list").parquet(f"{path}/vectors")
    lists_ = [(k, centres[k].tolist(), float(size[k]["radius"]) if k in size else -1.0, int(size[k]["n"]) if k in size else 0, parts.get(k, 0)) for k in range(len(centres))]
    spark.createDataFrame(lists_, "list int, centre array<double>, radius double, n long, parts int").coalesce(1).write.parquet(f"{path}/lists")
    info = BuildInfo(n, dims or 0, len(centres), min(n, sample), seed, kind, pyspark.__version__)
    spark.createDataFrame([(json.dumps(asdict(info)),)], "info string").coalesce(1).write.text(f"{path}/build_info")
    discard(rows, filed)
    return info


def load(spark: SparkSession, path: str) -> Index:
    info = BuildInfo(**json.loads(spark.read.text(f"{path}/build_info").first()[0]))
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # LISTS_MOST at most
    vectors = spark.read.schema(f"record_id {info.key_type}, v array<double>, part int, list int").parquet(f"{path}/vectors") if info.rows else spark.createDataFrame([], f"record_id {info.key_type}, v array<double>, part int, list int")
    return Index(info, vectors, np.array([r["centre"] for r in lists]).reshape(len(lists), -1), np.array([r["radius"] for r in lists]), np.array([r["parts"] for r in lists], np.int64))


def _asked(index: Index, queries: DataFrame, probes: int, again: bool) -> DataFrame:
    """(query_id, q, list, part): the parts to look into. again: of lists beyond the first ones, those that may hold a row above the query's least."""
    held = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.parts))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, parts = held.value
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column(1))
            near = np.where(parts > 0, q @ centres.T, -np.inf)
            place = np.argsort(-near, axis=1, kind="stable").argsort(1)
            if again:
                least = b.column(2).to_numpy(zero_copy_only=False)
                chosen = (place >= probes) & (parts > 0) & (near + radius >= least[:, None] - 2e-6)
            else:
                chosen = (place < probes) & (parts > 0)
            row, list_ = np.nonzero(chosen)
            row, list_, n = np.repeat(row, parts[list_]), np.repeat(list_, parts[list_]), parts[list_]
            part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(list_, pa.int32()), pa.array(part, pa.int32())], ["query_id", "q", "list", "part"])

    return queries.select("query_id", "q", *(["least"] if again else [])).mapInArrow(run, f"query_id {kind}, q array<double>, list int, part int")


def _scored(index: Index, asked: DataFrame, chunks: int, k: int) -> DataFrame:
    """(query_id, record_id, cosine): the k best rows of each part for each query that asks for it."""
    asked = materialize(asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")))
    lists = [r[0] for r in asked.select("list").distinct().collect()]  # LISTS_MOST at most
    rows = index.vectors.filter(F.col("list").isin(lists)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("record_id")
            q, v = _matrix(left.column("q")), _matrix(right.column("v"))
            for at in range(0, len(q), 256):
                score = np.round(q[at : at + 256] @ v.T, 6)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(at, at + len(score)), order.shape[1])
                out.append(pa.table({"query_id": left.column("query_id").take(pa.array(row)), "record_id": right.column("record_id").take(pa.array(order.ravel())), "cosine": np.take_along_axis(score, order, 1).ravel()}))
        return pa.concat_tables(out) if out else pa.table({"query_id": left.column("query_id")[:0], "record_id": right.column("record_id")[:0], "cosine": pa.array([], pa.float64())})

    by = ["list", "part", "chunk"]
    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(best, f"query_id {kind}, record_id {index.info.key_type}, cosine double")


def search(index: Index, queries: DataFrame, k: int = 5, probes: int = PROBES, exact: bool = True, least: float | None = None) -> DataFrame:
    """(query_id, record_id, cosine, rank): the k best rows for each query (query_id, embedding); with exact, the same as by comparing all."""
    asked = materialize(_unit(queries, "query_id", "embedding", "query_id", "q"))
    chunks = max(1, ceil(asked.count() / CHUNK))
    order = W.Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "record_id")  # k rows of each part that was looked into
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = materialize(_scored(index, _asked(index, asked, probes, False), chunks, k))
    if exact:
        kth = top(found).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("least"))
        open_ = asked.join(kth, "query_id", "left").na.fill(-2.0, ["least"])
        found = found.unionByName(_scored(index, _asked(index, open_, probes, True), chunks, k))
    out = top(found)
    return out if least is None else out.filter(F.col("cosine") >= least)


def built(df: DataFrame, **settings) -> Index:
    """An index in the shared folder, read again."""
    path = shared_dir(df.sparkSession)
    build(df, path, **settings)
    return load(df.sparkSession, path)
