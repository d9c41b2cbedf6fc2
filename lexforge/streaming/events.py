"""Event streams: windows, sessions and dedup, the same expressions for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of fixed windows; streams drop rows later than the watermark."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events no further apart than gap."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; streams keep state only inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def append_new(events: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """Appends rows whose key the log at path lacks, batch by batch; a repeated batch adds nothing."""
    def sink(batch: DataFrame, _: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(path).select(key)
            batch = batch.join(done, key, "left_anti")
        except Exception as e:  # the first batch finds no log
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
