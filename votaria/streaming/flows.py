"""Structured Streaming: idempotent ingest, tumbling and session windows, latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from votaria.sources.sinks import append_new


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """New files of a folder as a stream; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").format(kind).load(path)


def ingest(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append each key once, however often it is delivered: an exact anti-join for each batch, without unbounded state."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key, F.col(order)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_wanted(stream: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Issued work that has not come back: a stream against the table of what is done, read anew for each batch.

    What is missing when a batch runs is issued again with the next one; nothing is kept as state.
    """
    return stream.join(done.select(*key).distinct(), key, "left_anti")


def bounded_distinct(stream: DataFrame, at: str, key: list[str], late: str) -> DataFrame:
    """Each key once within the watermark; state is bounded by ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def tumbling(stream: DataFrame, at: str, size: str, late: str, by: list[str], value: str) -> DataFrame:
    """Count and mean per window and group; rows later than ``late`` are left out. Zone-less times are read as UTC."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *by, "n", "mean")


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions parted by ``gap``."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def latest_usage(stream: DataFrame, key: list[str], value: str) -> DataFrame:
    """The greatest value seen for each key (growing transcripts: the last usage of a message)."""
    return stream.groupBy(*key).agg(F.max(value).alias(value))
