"""Intermediate tables in the folder that all executors share, and sizes of what Spark will read."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which all executors reach. What is left of it goes when the driver ends.

    Only a local master may run without that setting: then a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lexforge-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/lexforge-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)
    _made.pop(path, None)


@atexit.register
def _delete_made() -> None:
    with suppress(Exception):  # the JVM may be gone
        for path, spark in list(_made.items()):
            delete_path(spark, path)


def size_of(df: DataFrame) -> int:
    """Bytes of df's rows, as Spark expects."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, part_bytes: int = 64 << 20) -> int:
    """How many partitions df's rows need, by the size that Spark expects, so that a task's share doesn't grow with the input."""
    size = size_of(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 52 else max(least, -(-size // part_bytes))  # beyond 4 PB: a size that Spark doesn't know


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that materialize() makes inside are discarded at the end, but for those given to the keep function."""
    held: list[DataFrame] = []
    _scratch.append(held)
    kept: list[DataFrame] = []
    try:
        yield kept.append
    finally:
        _scratch.pop()
        discard(*[t for t in held if not any(t is k for k in kept)])


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and a lost executor costs nothing. options: the writer's.

    Unlike checkpoint(), which runs its last stage twice and stores rows unpacked, this runs once and is columnar.
    """
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexforge_path = path
    for held in _scratch[-1:]:
        held.append(out)
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs, as it does once the driver's garbage collector has seen that no plan refers to them, which may take long."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that are no longer needed, and the shuffle files of finished jobs."""
    spark = None
    for t in tables:
        spark = t.sparkSession
        delete_path(spark, t._lexforge_path)
    if spark is not None:
        drop_shuffles(spark)
