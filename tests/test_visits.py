"""Streaming session state: visits whose lines cross files, against the batch pivot."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.streaming import visits

PATTERNS = [("start", r"^([^a-zA-Z]*) - browser - DEBUG : Visit Id: \d+"), ("cart", r"^([^a-zA-Z]*) - capture - INFO : Clicked to view cart Visit Id: \d+"), ("end", r"^([^a-zA-Z]*) - capture - (?:INFO|ERROR) : Will quit on \S+ Visit Id: \d+")]
LINES = {"start": "browser - DEBUG : Visit Id: {}", "cart": "capture - INFO : Clicked to view cart Visit Id: {}", "end": "capture - ERROR : Will quit on http://a/ Visit Id: {}"}


def line(at, phase, visit):
    return f"2024-05-01 {at} - {LINES[phase].format(visit)}"


FILES = [
    [line("10:00:00", "start", 1), line("10:05:00", "start", 2), "noise without a visit", line("10:06:00", "cart", 1)],
    [line("10:20:00", "end", 1), line("10:12:00", "cart", 2), line("10:01:00", "cart", 1), line("10:03:00", "start", 1)],  # late ones, and a repeated phase
    [line("10:30:00", "end", 2), line("10:59:00", "start", 3)],
    [line("23:00:00", "start", 4)],  # moves the watermark on
    [line("23:30:00", "end", 4)],
    [line("10:31:00", "cart", 1)],  # later than the watermark: dropped
]


def test_visits_cross_files(spark, tmp_path):
    for k, lines in enumerate(FILES):
        path = tmp_path / "in" / f"{k}.log"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
        when = dt.datetime(2024, 1, 1).timestamp() + k
        import os

        os.utime(path, (when, when))  # files are read in the order of their times
    stream = visits.log_lines(spark, str(tmp_path / "in"), PATTERNS, "yyyy-MM-dd HH:mm:ss", files_per_batch=1)
    got = visits.saved(visits.visit_phases(stream, "visit_id", "phase", "at"), str(tmp_path / "out"), str(tmp_path / "check")).collect()
    text = spark.read.text([str(tmp_path / "in" / f"{k}.log") for k in (0, 1, 2)])
    phase = F.when(F.col("value").rlike(PATTERNS[0][1]), "start").when(F.col("value").rlike(PATTERNS[1][1]), "cart").when(F.col("value").rlike(PATTERNS[2][1]), "end")
    batch = text.select(F.regexp_extract("value", r"Visit Id: ([0-9]+)", 1).alias("v"), phase.alias("phase"), F.left("value", F.lit(19)).try_cast("timestamp").alias("at")).filter("phase IS NOT NULL")
    want = batch.groupBy(F.col("v").cast("long").alias("visit"), "phase").agg(F.max("at").alias("at")).collect()
    assert len(want) == 7 and sorted(map(tuple, got)) == sorted(map(tuple, want))
