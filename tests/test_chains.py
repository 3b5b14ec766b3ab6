"""Chains of deep pages."""

from millrace.operators import dom, layout


def test_chains_of_a_deep_page_take_few_joins(spark):
    deep = 70
    nodes = dom.nodes(spark.createDataFrame([(1, "<div>" * deep + "x" + "</div>" * deep), (2, "<p>a</p>")], "page_id long, html string"))
    chains = layout.chains(nodes)
    assert chains._jdf.queryExecution().analyzed().toString().count("Join") < 10
    got = {(r.page_id, r.node_id): [c.id for c in r.chain] for r in chains.collect()}
    assert got == {(1, k): list(range(k + 1)) for k in range(deep)} | {(2, 0): [0]}


def test_chains_are_never_broadcast(spark):
    nodes = dom.nodes(spark.createDataFrame([(1, "<a>x</a><p><a>y</a></p>")], "page_id long, html string"))
    pairs = spark.createDataFrame([(1, 0, 2)], "page_id long, a long, b long")
    assert "Broadcast" not in layout.tree_distance(pairs.hint("merge"), layout.chains(nodes))._jdf.queryExecution().executedPlan().toString()
