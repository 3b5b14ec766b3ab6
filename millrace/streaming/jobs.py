"""Streaming forms of the incremental jobs: first-seen rows, poll logs, sessions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLL = "kind string, name string, body string, headers string"


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten after `delay`, so the state is bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def poll_log(spark: SparkSession, path: str) -> DataFrame:
    """New lines of an append-only log of API answers, tab-separated."""
    lines = spark.readStream.schema(POLL).option("sep", "\t").csv(path)
    return lines.filter(F.col("kind").startswith("API-Response"))


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events a window and key, given out once the watermark has passed."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Start, end and size of each key's sessions, which end after a gap."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there now, as a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
