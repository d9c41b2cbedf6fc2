"""Sinks: Parquet and CSV by split, appendable JSON logs, a key-value cache, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.storage import delete_path


def corpus(df: DataFrame, path: str) -> None:
    """Parquet in partitions of data set and split, each file sorted by id."""
    df.repartition("source_dataset", "split").sortWithinPartitions("id").write.mode("overwrite").partitionBy("source_dataset", "split").parquet(path)


def split_csv(df: DataFrame, path: str) -> None:
    """id and label in order of id, over as many files as the order's ranges; equal inputs give equal rows."""
    df.select("id", "label").orderBy("id").write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def unfinished(inputs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Inputs that a log lacks: a run goes on where it stopped."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Of each key (key, value, created) the latest entry; failures (null values) are never stored."""
    both = cache.unionByName(new.filter(F.col("value").isNotNull()))
    return both.groupBy("key").agg(F.max_by(F.struct("value", "created"), "created").alias("x")).select("key", "x.*")


#: Buckets of a cache, and from how many versions of a bucket on it is written anew.
BUCKETS, VERSIONS = 256, 4
_CACHE = "key string, value string, created double"


def cache_read(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, created, bucket): each key's latest entry, merged on reading. An empty frame if nothing was written."""
    if not _folders(spark, path):
        return spark.createDataFrame([], f"{_CACHE}, bucket int")
    rows = spark.read.schema(f"{_CACHE}, v long, bucket int").parquet(path)
    return rows.groupBy("bucket", "key").agg(F.max_by(F.struct("value", "created"), F.struct("created", "v")).alias("x")).select("key", "x.*", "bucket")


def cache_upsert(new: DataFrame, path: str, buckets: int = BUCKETS, versions: int = VERSIONS) -> list[int]:
    """Adds entries (key, value, created) to a cache, and returns the buckets that were written anew.

    New entries go to files of their own, by hash buckets of the key, below a version's folder; nothing that is there is touched. A bucket that has
    its versions-th version by then is merged, written as one and its older files are deleted; the others stay. Failures (null
    values) are never stored. A writer that is lost leaves the old files, or old and new ones, which read alike.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    version = max([v for v, _ in _folders(spark, path, "v=*")], default=-1) + 1
    delta = new.filter(F.col("value").isNotNull() & F.col("key").isNotNull()).select("key", "value", "created", bucket.alias("bucket"))
    delta.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/v={version}")
    held: dict[int, list[int]] = {}
    for v, b in _folders(spark, path):
        held.setdefault(b, []).append(v)
    full = sorted(b for b, vs in held.items() if version in vs and len(vs) >= versions)
    if full:
        merged = cache_read(spark, path).filter(F.col("bucket").isin(full))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/v={version + 1}")
        for b in full:
            for v in held[b]:
                delete_path(spark, f"{path}/v={v}/bucket={b}")
    return full


def _folders(spark: SparkSession, path: str, below: str = "v=*/bucket=*") -> list[tuple[int, int | None]]:
    """(version, bucket) of a cache's folders."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{below}")
    found = [s.getPath().toString().split("/") for s in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []]
    return [(int(p[-2][2:]), int(p[-1][7:])) if p[-1].startswith("bucket=") else (int(p[-1][2:]), None) for p in found]


def markdown(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A small frame, of most rows at most, as a Markdown table."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    shown = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join([*head, *(f"| {' | '.join(map(shown, r))} |" for r in rows)])


def json_summary(df: DataFrame, most: int = 1000) -> str:
    """A small frame, of most rows at most, as one JSON array of objects."""
    rows = df.toJSON().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return "[" + ", ".join(rows) + "]"


def table_csv(df: DataFrame, path: str, order: str) -> None:
    """Errors or predictions as CSV in order of a column, quoted where needed."""
    df.orderBy(order).write.mode("overwrite").options(header=True, escape='"').csv(path)


def config_version(values: DataFrame, path: str, version: int) -> None:
    """Thresholds (name, value) as a new version beside the old ones; a configuration is never edited in place."""
    values.select("name", "value", F.lit(version).alias("version")).write.mode("append").parquet(path)


def latest_config(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of each name's latest version."""
    rows = spark.read.schema("name string, value double, version int").parquet(path)
    return rows.groupBy("name").agg(F.max_by("value", "version").alias("value"))


def vector_index(df: DataFrame, path: str, partitions: int = 64) -> None:
    """record_id, embedding and meta as Parquet, dealt by id."""
    df.repartition(partitions, "record_id").write.mode("overwrite").parquet(path)
