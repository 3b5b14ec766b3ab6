"""Nodes of many pages come in bounded batches."""

import pyarrow as pa

from millrace.operators import dom


def test_nodes_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(dom, "BATCH_ROWS", 10)
    given = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["<p>a<b>c</b></p>"] * 49 + [None])], ["page_id", "html"])
    out = list(dom.batched(iter([given]), lambda ns: [(k, n["tag"]) for k, n in enumerate(ns)], pa.schema(dom._arrow("page_id long, node_id long, tag string"))))
    assert sum(b.num_rows for b in out) == 98 and max(b.num_rows for b in out) <= 11


def test_columns_left_out(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>c</b></p>")], "page_id long, html string")
    some, every = dom.nodes(pages, ("text", "said", "attrs")), dom.nodes(pages)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(*some.columns).collect())) and set(every.columns) - set(some.columns) == {"text", "said", "attrs"}
