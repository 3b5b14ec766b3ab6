"""Per-visit state of log lines, streaming: the phases of a visit are gathered from lines that may come in any
order and in any file, and given out when the visit has been silent for a gap of event time.

The state of a visit is one value, its phases with their last times, and one event-time timer, which every line of the visit puts off. A
batch's lines of a visit are put together before the state is read and written, once.
When the watermark passes it, the phases are given out as (visit, phase, time) and the state goes, so that the state is bounded by
the visits that are open. A line later than the watermark's delay is dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Phases(StatefulProcessor):
    """Rows (visit, phase, at, ms) of a visit in, one row for each of its phases out."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "phases array<string>, ms array<long>, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, found = 0, {}
        for row in rows:
            found[row.phase] = max(row.ms, found.get(row.phase, row.ms))
            last = max(last, row.ms)
        known = self.open.get()
        phases, before = (dict(zip(known[0], known[1])), known[2]) if known is not None else ({}, None)
        for phase, ms in found.items():
            phases[phase] = max(ms, phases.get(phase, ms))
        after = max(last + self.gap_ms, before if before is not None else 0)
        self.open.update((list(phases), list(phases.values()), after))
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        phases, times, _ = self.open.get()
        self.open.clear()
        for phase, ms in sorted(zip(phases, times)):
            yield Row(visit=key[0], phase=phase, ms=ms)

    def close(self) -> None:
        pass


def visit_phases(stream: DataFrame, visit: str, phase: str, ts: str, gap_minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """(visit, phase, at) of each visit of a stream once it has been silent for the gap; of lines that repeat a
    phase, the last by time. Lines without visit, phase or time are left out."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = stream.filter(F.col(visit).isNotNull() & F.col(phase).isNotNull() & F.col(ts).isNotNull())
    named = rows.select(F.col(visit).cast("long").alias("visit"), F.col(phase).alias("phase"), F.col(ts).cast("timestamp").alias("at")).withColumn("ms", F.unix_millis("at"))
    out = named.withWatermark("at", delay).groupBy("visit").transformWithState(Phases(gap_minutes * 60_000), "visit long, phase string, ms long", "Append", "EventTime")
    return out.select("visit", "phase", F.timestamp_millis("ms").alias("at"))


def saved(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream gives for the input that is there now, written to `path` by the tasks and read back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def log_lines(spark: SparkSession, path: str, patterns: list[tuple[str, str]], time_format: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (visit_id, phase, at) from log files: the first pattern that fits names the phase, its group 1
    is the time, and the visit is the number after its name."""
    from ..operators.relational import first_match

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    time = F.coalesce(*(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)) for _, p in patterns))
    at = F.try_to_timestamp(F.trim(time), F.lit(time_format))
    return lines.select(F.regexp_extract("value", r"Visit Id: ([0-9]+)", 1).try_cast("long").alias("visit_id"), first_match(F.col("value"), patterns).alias("phase"), at.alias("at")).filter("phase IS NOT NULL")
