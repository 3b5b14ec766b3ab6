"""Popup containers and their close buttons, over node tables with computed styles.

Columns beside those of `dom.nodes`: shown, positioned (its position isn't static), z (z-index; null for auto), width, height and centred
(it holds the middle of the window).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import below, in_page

#: A popup is larger than this, both ways.
LEAST_SIDE = 150
# Elements that may close a dialog, what their attributes and their own texts say.
CLOSING_TAGS = ("button", "a", "div", "span", "img", "label")
CLOSING_ATTRIBUTES = ("close", "Close", "dismiss", "Dismiss")
CLOSING_TEXTS = ("Agree", "AGREE", "ENTER", "Enter", "YES", "Yes", "No ", "NO ")


def without_holders(listed: DataFrame, base: str | None = None) -> DataFrame:
    """Listed nodes that hold no other listed one. With a `base` tag, nodes of other tags below a listed node of that tag
    go first, so that a button stays and not the icon in it. The next listed node tells: it lies below if at all one does."""
    if base:
        listed = listed.withColumn("_inside", below(F.col("tag") == base) & (F.col("tag") != base)).filter("NOT _inside").drop("_inside")
    nearest = F.lead("node_id").over(in_page())
    return listed.withColumn("_next", nearest).filter(F.col("_next").isNull() | (F.col("_next") > F.col("end_id"))).drop("_next")


def stacked(nodes: DataFrame, marked: Column, name: str) -> DataFrame:
    """`nodes` with the number of marked nodes above each: those that begin before it, less those that end before it."""
    starts = nodes.withColumn("_begun", F.coalesce(F.sum(marked.cast("int")).over(in_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = nodes.filter(marked).groupBy("page_id", F.col("end_id").alias("node_id")).agg(F.count("*").alias("_ends"))
    joined = starts.join(ends, ["page_id", "node_id"], "left")
    over = F.coalesce(F.sum("_ends").over(in_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(name, F.col("_begun") - over).drop("_begun", "_ends")


def popup_containers(nodes: DataFrame) -> DataFrame:
    """The container of each page that has one. From the body inwards: of the candidates (shown, positioned divs of positive z-index that
    hold the window's middle and are large) without a z-index between them and the container so far, the one of largest z-index, the
    first of several; its only child, if that is a frame."""
    levelled = stacked(nodes, F.col("z").isNotNull(), "_level")
    large = (F.col("width") > LEAST_SIDE) & (F.col("height") > LEAST_SIDE)
    fits = (F.col("tag") == "div") & F.col("shown") & F.col("positioned") & (F.coalesce("z", F.lit(0)) > 0) & F.col("centred") & large
    body = levelled.filter("tag = 'body'").groupBy("page_id").agg(F.min(F.struct("node_id", "end_id", (F.col("_level") + F.col("z").isNotNull().cast("int")).alias("inner"))).alias("body"))
    candidates = levelled.filter(fits).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "end_id", F.col("z").cast("double").alias("z"), F.col("_level").alias("level")))).alias("c"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for top, rest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, inner = None, top["inner"]
                rest = [c for c in rest if top["node_id"] < c["node_id"] <= top["end_id"]]
                while free := [c for c in rest if c["level"] == inner]:
                    at = max(free, key=lambda c: (c["z"], -c["node_id"]))
                    rest, inner = [c for c in rest if at["node_id"] < c["node_id"] <= at["end_id"]], at["level"] + 1
                chosen.append(at["node_id"] if at else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int64())], ["_page", "_id"])

    found = body.join(candidates, "page_id").select("page_id", "body", "c").mapInArrow(choose, "_page long, _id long").filter("_id IS NOT NULL")
    kids = nodes.groupBy("page_id", F.col("parent_id").alias("_id")).agg(F.count("*").alias("n"), F.min(F.struct("node_id", "tag")).alias("kid")).filter("n = 1 AND kid.tag = 'iframe'")
    kids = kids.select(F.col("page_id").alias("_page"), "_id", F.col("kid.node_id").alias("_frame"))
    found = found.join(kids, ["_page", "_id"], "left").select("_page", F.coalesce("_frame", "_id").alias("_id"))
    return nodes.join(found, (F.col("page_id") == F.col("_page")) & (F.col("node_id") == F.col("_id"))).drop("_page", "_id")


def close_buttons(nodes: DataFrame, containers: DataFrame) -> DataFrame:
    """Shown nodes below each page's container that close it, as far as an attribute (without a slash) or a text of their own says; of nested
    ones the innermost, but a button rather than what it holds."""
    inside = containers.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_from"), F.col("end_id").alias("_to"))
    near = nodes.filter(F.col("tag").isin(*CLOSING_TAGS) & F.col("shown")).join(inside, F.col("page_id") == F.col("_page")).filter(F.col("node_id").between(F.col("_from") + 1, F.col("_to"))).drop("_page", "_from", "_to")
    says = F.exists(F.map_values("attrs"), lambda v: v.rlike("|".join(CLOSING_ATTRIBUTES)) & ~v.contains("/"))
    return without_holders(near.filter(says | F.col("said").rlike("|".join(CLOSING_TEXTS))), "button")
