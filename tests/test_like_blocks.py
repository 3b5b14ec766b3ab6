"""Blocks by likeness without a row for each ancestor."""

from millrace.operators import dom


def test_no_row_for_each_ancestor(spark):
    pages = spark.createDataFrame([(1, "<div><p>a</p><a href='x'>b</a></div>")], "page_id long, html string")
    assert "Generate" not in dom.similar_blocks(dom.nodes(pages), dom.content_vectors(pages))._jdf.queryExecution().executedPlan().toString()
