"""A block without a parent holds no other one for that."""

from millrace.operators import dom


def test_a_lone_block_at_the_top_stays(spark):
    listed = spark.createDataFrame([(1, "/div[1]"), (2, "/div[1]"), (2, "/div[1]/div[1]")], "page_id long, path string")
    assert sorted(map(tuple, dom.without_nested(listed).collect())) == [(1, "/div[1]"), (2, "/div[1]/div[1]")]
