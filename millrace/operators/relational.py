"""Relational operators over any DataFrame. Every ranking has a total order, given by the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in `order`."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ascending `order` (nulls first). An aggregate, so that each task sends one row
    a key at most, not all of them."""
    at = F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))
    last = df.groupBy(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys))).agg(F.max_by(F.struct(*df.columns), at).alias("_row"))
    return last.select("_row.*")


def mark_join(left: DataFrame, right: DataFrame, key: str, other: str, flag: str) -> DataFrame:
    """`left` with a flag: whether `right` has the key. No row of `left` is lost or repeated."""
    known = right.select(F.col(other).alias("_k")).distinct()
    return left.join(known, F.col(key) == F.col("_k"), "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def lookup_last(left: DataFrame, table: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """`left` with `value` of the table's last row (by `position`) with its key; rows without one go."""
    last = table.groupBy(key).agg(F.max_by(value, position).alias(value))
    return left.join(last, key)


def with_group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row value and the given column values; absent ones are 0."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


#: Accuracy of the sketches that bracket a rank, and values of a bracket that come to the driver.
ACCURACY, FEW = 10_000, 4096


def rank_values(df: DataFrame, column: str, ranks: set[int]) -> dict[int, float]:
    """The values at 0-based ranks of a numeric column in ascending order (nulls left out), exactly, without a sort.

    A round brackets each rank between two values of a mergeable sketch, counts what lies below, on and between them,
    and goes on inside, where less than a thousandth of the rows is left; FEW values are looked at themselves. Values that
    many rows share are told by their counts."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    open_, known = {r: (None, None, 0) for r in ranks}, {}  # rank: bounds (both outside), number of values up to the lower
    inside = {r: None for r in ranks}

    def within(r: int) -> Column:
        low, high, _ = open_[r]
        return (F.lit(True) if low is None else F.col("x") > low) & (F.lit(True) if high is None else F.col("x") < high)

    total = x.count()
    inside = dict.fromkeys(ranks, total)
    while open_:
        small = [r for r in open_ if inside[r] <= FEW]
        if small:
            lists = x.agg(*(F.array_sort(F.collect_list(F.when(within(r), F.col("x")))).alias(str(r)) for r in small)).first()
            for r in small:
                known[r] = lists[str(r)][r - open_.pop(r)[2]]
        if not open_:
            break
        sketches = []
        for r, (_, _, below) in open_.items():
            q, slack = (r - below) / (inside[r] - 1), 3 / ACCURACY
            sketches.append(F.approx_percentile(F.when(within(r), F.col("x")), [max(0.0, q - slack), min(1.0, q + slack)], ACCURACY).alias(str(r)))
        bounds = x.agg(*sketches).first()
        marks = [(r, *bounds[str(r)]) for r in open_]
        kinds = lambda r, a, b: (F.col("x") < a, F.col("x") == a, (F.col("x") > a) & (F.col("x") < b), F.col("x") == b)
        counts = x.agg(*(F.count_if(c).alias(f"{r}_{k}") for r, a, b in marks for k, c in enumerate(kinds(r, a, b)))).first()
        for r, a, b in marks:
            below, on_a, between, on_b = (counts[f"{r}_{k}"] for k in range(4))
            if below <= r < below + on_a:
                known[r] = a
            elif a < b and below + on_a + between <= r < below + on_a + between + on_b:
                known[r] = b
            elif r < below:
                open_[r], inside[r] = (open_[r][0], a, open_[r][2]), below - open_[r][2]
                continue
            elif r < below + on_a + between:
                open_[r], inside[r] = (a, b, below + on_a), between
                continue
            else:
                up_to = below + on_a + between + (on_b if a < b else 0)
                upper = open_[r][2] + inside[r]
                open_[r], inside[r] = (b, open_[r][1], up_to), upper - up_to
                continue
            open_.pop(r)
    return known


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; null for a column without values."""
    n = df.select(F.count(column)).first()[0]
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    values = rank_values(df, column, {k for a in at for k in (math.floor(a), math.ceil(a))})
    return [values[math.floor(a)] + (values[math.ceil(a)] - values[math.floor(a)]) * (a - math.floor(a)) for a in at]


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact linear quartiles, maximum: one row."""
    c = F.col(column)
    quartiles = [F.lit(v).cast("double").alias(n) for v, n in zip(quantiles(df, column, [0.25, 0.5, 0.75]), ("q1", "median", "q3"))]
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("least"), *quartiles, F.max(c).alias("most"))


def duplicate_audit(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat an earlier row's key, and how many don't; by key counts, not by rows."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("first_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))


def _draw(key: str, seed: int) -> Column:
    """A digest of seed and key: a random order that is the same in each run."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key)))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in each run."""
    return df.orderBy(_draw(key, seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(group).orderBy(_draw(key, seed), key))
    return df.withColumn("_at", at).filter(F.col("_at") <= n).drop("_at")


#: Rows that a range of a distributed order should hold.
RANGE_ROWS = 1 << 20


def numbered(df: DataFrame, order: list[str], at: str, total: str | None = None) -> DataFrame:
    """`df` with each row's place in an order (from 1), and the number of rows. Places come from counts of ranges, so no task
    sorts all rows; there are as many ranges as the rows ask for. The ranged rows are written first: dealt out twice, they might get
    other ranges."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    ranged = Scratch(df.sparkSession, "order").save(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = per.select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), F.col("_part") == F.col("_of"))
    placed = placed.withColumn(at, F.col("_at") + F.col("_before"))
    return (placed.withColumn(total, F.col("_all")) if total else placed).drop("_part", "_of", "_n", "_before", "_all", "_at")


def shuffled(df: DataFrame, key: str, at: str, seed: int = 0) -> DataFrame:
    """`df` with each row's place in a random order of all rows, the same in each run."""
    return numbered(df.withColumn("_draw", _draw(key, seed)), ["_draw", key], at).drop("_draw")


def ordered_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """Whether a row is among the first floor(share * n) rows."""
    return numbered(df, [order], "_place", "_total").withColumn("in_head", F.col("_place") <= F.floor(F.col("_total") * share)).drop("_place", "_total")


def chunked(df: DataFrame, order: list[str], chunks: int, name: str = "chunk") -> DataFrame:
    """The number (from 1) of each row's chunk of an order cut in near-equal chunks, the first ones a row longer."""
    at, size, longer = F.col("_place") - 1, F.floor(F.col("_total") / chunks), F.col("_total") % chunks
    head = longer * (size + 1)
    chunk = F.when(at < head, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - head) / F.greatest(size, F.lit(1))))
    return numbered(df, order, "_place", "_total").withColumn(name, (chunk + 1).cast("int")).drop("_place", "_total")


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of `left` beside the n-th of `right`, as far as the shorter goes; their column names differ."""
    return numbered(left, [left_order], "_place").join(numbered(right, [right_order], "_place"), "_place").drop("_place")


def split_by_count(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three disjoint parts that add up to `df`: rows whose key is null, single, or repeated."""
    sized = with_group_size(df, [key], "_n")
    return (
        sized.filter(F.col(key).isNull()).drop("_n"),
        sized.filter(F.col(key).isNotNull() & (F.col("_n") == 1)).drop("_n"),
        sized.filter(F.col(key).isNotNull() & (F.col("_n") > 1)).drop("_n"),
    )


def first_match(value: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that a text has; null if none."""
    cases = F
    out = None
    for name, pattern in patterns:
        out = (cases if out is None else out).when(value.rlike(pattern), name)
    return out


def pattern_join(rows: DataFrame, patterns: list[tuple[str, str]], domain: str, url: str) -> DataFrame:
    """Rows with the patterns that fit them: '#text' fits URLs that contain the text, anything else the
    registrable domain. One pass over the rows, whatever the number of patterns."""
    fits = [(F.contains(F.col(url), F.lit(p[1:])) if p.startswith("#") else F.col(domain) == p, n) for n, p in patterns]
    found = F.array_compact(F.array(*(F.when(fit, F.lit(n)) for fit, n in fits)))
    return rows.withColumn("provider", F.explode(found))
