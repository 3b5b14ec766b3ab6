"""Sinks: thin names for what Spark's writers do, and the few layouts that need a plan of their own."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def tsv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Sorted, without a header."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").option("sep", "\t").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_dict(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object of a table of bounded size (a report): keys in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("append").text(path)


def chunks(df: DataFrame, order: str, n: int, path: str) -> None:
    """n near-equal files of a sorted list, the larger ones first."""
    from ..operators.relational import chunked

    chunked(df, [order], n).write.mode("overwrite").partitionBy("chunk").csv(path)


def matrix(df: DataFrame, column: str, path: str) -> None:
    """A dense matrix: the numbers of an array column, a line a row, with spaces between them."""
    df.select(F.array_join(F.transform(column, lambda x: x.cast("string")), " ", "nan")).write.mode("overwrite").text(path)


def sparse_matrix(df: DataFrame, id_col: str, features: str, path: str) -> None:
    """A sparse matrix by rows: id, indices and values of the non-zero places."""
    from ..operators.sparse import layout

    layout(df, id_col, features).write.mode("overwrite").parquet(path)


#: What a plan's text says anew each time, and leaves whose rows or code it doesn't say at all.
FRESH = re.compile(r"#\d+L?|plan_id=\d+|(?<=\bx_)\d+|(?<=\by_)\d+")
UNSAID = re.compile(r"LogicalRDD|LocalRelation|MapInArrow|MapInPandas|FlatMap\w+|\w*Python\w*|\w*UDF\w*")


def plan_digest(df: DataFrame, version: str = "") -> str:
    """SHA-256 of what a result depends on: the analysed plan, and path, length and time of each input file. A plan over rows in
    memory or with functions of the caller's needs a `version` that stands for them."""
    spark, key = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 20))
    try:
        plan = FRESH.sub("", df._jdf.queryExecution().analyzed().toString())
    finally:
        spark.conf.set(key, before)
    if not version and UNSAID.search(plan):
        raise ValueError("rows in memory or functions aren't part of a plan's text: give a version")
    path, conf, files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        at = path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        files.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr((version, plan, files)).encode()).hexdigest()


def cached(df: DataFrame, path: str, version: str = "") -> DataFrame:
    """The rows of `df`, from a table below `path` if one has been written whole for this plan and these input files; else
    they are written there. A table counts only with the marker that its commit writes last, so a half-written one is written again."""
    spark, at = df.sparkSession, f"{path.rstrip('/')}/{plan_digest(df, version)}"
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
