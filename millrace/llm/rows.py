"""Rows that a decision on documents leaves: a decision is on a doc_id and a text, so that rows which share
only one of them keep their own fate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, free_name


def text_sha(text: str = "text") -> Column:
    """SHA-256 of a text in UTF-8, lowercase hex; a null text is empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def take_rows(scratch: Scratch, docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id and text `taken` names, each so often: doc_id, sha, n (how many rows of
    `docs` have both) and copies (for all of them together; which of them gives its other columns is open).
    Columns as in `docs`; a null doc_id is a value like any other."""
    taken = scratch.save(taken.select(F.col("doc_id").cast("long").alias("__taken_id"), F.col("sha").alias("__taken_sha"), F.col("n").alias("__n"), F.col("copies").alias("__copies")), "taken")
    id_, sha, row = (free_name(docs, stem) for stem in ("__id", "__sha", "__row"))
    marked = docs.select(F.struct(*docs.columns).alias(row), F.col("doc_id").cast("long").alias(id_), text_sha().alias(sha))
    same = F.col(id_).eqNullSafe(F.col("__taken_id")) & (F.col(sha) == F.col("__taken_sha"))
    found = marked.join(taken.filter("__n = 1"), same).select(row, "__copies")
    repeated = taken.filter("__n > 1")
    if not repeated.isEmpty():
        # summed before they move, so rows that repeat very often are no task's burden
        one = marked.groupBy(id_, sha).agg(F.first(row).alias(row)).join(repeated, same)
        found = found.unionByName(one.select(row, "__copies"))
    return found.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(f"{row}.*")


def keep_rows(scratch: Scratch, docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id and text `kept` (doc_id, sha, n: how many rows have both) names; of
    rows that repeat both, one, whichever."""
    return take_rows(scratch, docs, kept.withColumn("copies", F.lit(1)))
