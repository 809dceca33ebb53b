"""Streams over append-only events: latest state by key, sessions, idempotent ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.sources.writers import append_events


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_by_key(stream: DataFrame, key: str, time: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """The last row of each key by time, then ordinal; an update stream whose state is one row a key."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, ordinal)).alias("_")).select(key, "_.*")


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts of tumbling windows; rows later than `late` behind the newest are left out, and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Rows of each session of a key."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ingest(stream: DataFrame, log: str, checkpoint: str, key: str = "event_id", content: str = "content_hash"):
    """Appends each micro-batch's new events to a log; a batch that is run again appends nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_events(batch, log, key, content)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def last_of_batch(rows: DataFrame, key: str, time: str, ordinal: str) -> DataFrame:
    """The same view of a batch."""
    newest = Window.partitionBy(key).orderBy(F.desc(time), F.desc(ordinal))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
