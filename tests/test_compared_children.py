"""Children are compared only where a split depends on them."""

from pyspark.sql import functions as F

from millrace.operators import dom, layout


def test_children_that_decide_nothing_are_not_compared(spark):
    pages = spark.createDataFrame([(1, "<body><div><p>a</p><p>b</p></div></body>")], "page_id long, html string")
    nodes = dom.nodes(pages).withColumn("shown", F.lit(True))
    for c in ("left", "top", "width", "height"):
        nodes = nodes.withColumn(c, F.lit(10.0))
    got = layout.similarity_segments(nodes, dom.content_vectors(pages), measure=lambda *_: 1 / 0)
    assert [r.tag for r in got.collect()] == ["body"]
