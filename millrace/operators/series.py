"""Ordered-series operators: differences, modes and the countdown test, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_difference(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "diff") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def with_gap_seconds(df: DataFrame, keys: list[str], order: list[str], ts: str, name: str = "gap") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn(name, (micros - F.lag(micros).over(w)) / 1e6)


def elapsed_minutes(first: Column, last: Column) -> Column:
    """Minutes from one time to another, with their fraction."""
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 60e6


def mode_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent non-null value a key (the least of several) and its count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_m"), F.col(value).alias("_v"))).alias("_b"))
    return best.select(*keys, F.col("_b._v").alias(name), (-F.col("_b._m")).alias(f"n_{name}"))


def countdowns(df: DataFrame, keys: list[str], order: list[str], value: str, ts: str, enough: int = 5) -> DataFrame:
    """Per group: numbers of falling and rising steps, three flags and `is_timer`, which needs all.

    decreasing: at least `enough` falls, and no rise or more than `enough` times as many falls as rises.
    by_mode: at least `enough` distinct values and falls, and no rise, or: the most frequent step isn't
    a rise, the most frequent fall comes `enough` times, and falls outnumber rises.
    seconds: at least `enough` distinct whole seconds. Groups with a null key are left out."""
    rows = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    steps = with_difference(rows, keys, order, value, "_d")
    sums = steps.groupBy(*keys).agg(
        F.count_if(F.col("_d") < 0).alias("n_neg"), F.count_if(F.col("_d") > 0).alias("n_pos"), F.count_distinct(value).alias("_values"),
        F.count_distinct(F.date_trunc("second", ts)).alias("_seconds"),
    )
    mode = mode_of(steps, keys, "_d", "_mode").drop("n__mode")
    fall = mode_of(steps.withColumn("_f", F.when(F.col("_d") < 0, F.col("_d"))), keys, "_f", "_fall")
    all_ = sums.join(mode, keys, "left").join(fall, keys, "left")
    neg, pos = F.col("n_neg"), F.col("n_pos")
    decreasing = (neg >= enough) & ((pos == 0) | (neg > pos * enough))
    usual = (F.col("_mode") <= 0) & (F.coalesce(F.col("n__fall"), F.lit(0)) >= enough) & (neg > pos)
    by_mode = (F.col("_values") >= enough) & (neg >= enough) & ((pos == 0) | F.coalesce(usual, F.lit(False)))
    flagged = all_.withColumn("decreasing", decreasing).withColumn("by_mode", by_mode).withColumn("seconds", F.col("_seconds") >= enough)
    return flagged.withColumn("is_timer", F.col("decreasing") & F.col("by_mode") & F.col("seconds")).select(*keys, "n_neg", "n_pos", "decreasing", "by_mode", "seconds", "is_timer")


def running_concat(df: DataFrame, key: str, order: str, value: str, separator: str = "") -> DataFrame:
    """so_far: the values of a key's rows up to each row, in `order`, joined; nulls are left out."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("so_far", F.array_join(F.collect_list(value).over(upto), separator))
