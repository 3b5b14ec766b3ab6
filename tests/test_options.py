"""Product options: a page with every kind, and groups of toggles against all pairs of random trees."""

import random

from pyspark.sql import functions as F

from millrace.operators import dom, layout, options

PAGE = """<body><ul><li>Small</li><li>Medium</li><li>Large</li><li>Share it</li></ul><p>x</p><p>y</p><p>z</p><div><label>Red</label><label>Blue</label><label>Cart</label></div>
<select><option>Choose a size</option><option>1 l</option><option>2 l</option></select></body>"""
OPENED = "<body><div><span>Colour</span><ul><li>Red</li><li>Green</li></ul></div><p><span>Sign in</span></p></body>"


def styled(spark, pages, hidden=()):
    n = dom.nodes(spark.createDataFrame(pages, "page_id long, html string"))
    small = F.col("tag").isin("li", "label", "span", "select")
    return n.select(
        "*", (~F.col("tag").isin(*hidden) if hidden else F.lit(True)).alias("shown"), F.lit(400.0).alias("left"), (300.0 + 10 * F.col("node_id")).alias("top"), F.when(small, 60.0).otherwise(900.0).alias("width"),
        F.when(small, 24.0).otherwise(500.0).alias("height"), F.col("tag").isin("li", "label", "span").alias("border"), F.when(F.col("tag").isin("li", "label"), "inline-block").alias("display"), F.lit(None).cast("string").alias("float"), F.lit(None).cast("boolean").alias("fixed"),
    )


def found(df, nodes):
    names = {(r.page_id, r.node_id): r.text for r in nodes.collect()}
    out = {}
    for r in df.collect():
        out.setdefault((r.page_id, r.place, r.kind), set()).add(names[r.page_id, r.option])
    return out


def test_every_kind(spark):
    nodes = styled(spark, [(1, PAGE), (2, ""), (3, None)]).cache()
    assert found(options.product_options(nodes, 1000.0), nodes) == {(1, 1, "toggle"): {"Small", "Medium", "Large"}, (1, 2, "toggle"): {"Red", "Blue"}, (1, 3, "select"): {"1 l", "2 l"}}
    hidden = styled(spark, [(7, OPENED)], ("ul", "li")).cache()
    assert found(options.product_options(hidden, 1000.0), hidden) == {(7, 1, "opened"): {"Red", "Green"}}
    assert options.product_options(nodes.limit(0), 1000.0).count() == 0


def test_toggles_keep_the_rules(spark):
    html = "<body><ul><li>1</li><li><a href='/x%20y'>Oak</a></li><li><a href='https://facebook.com/'>Elm</a></li><li><a class='cart'>Ash</a></li><li><input type='radio'>Fir</li><li><input type='text'>Yew</li></ul></body>"
    nodes = styled(spark, [(1, html)]).cache()
    said = {r.text for r in options.toggle_nodes(nodes, 1000.0).filter("tag = 'li'").collect()}
    assert said == {"Oak", "Fir"}
    wide = nodes.withColumn("width", F.lit(270.0))
    assert options.toggle_nodes(wide, 1000.0).count() == 0 and options.toggle_nodes(nodes.withColumn("border", F.lit(False)), 1000.0).count() == 0


def test_near_pairs_are_all_near_pairs(spark):
    rng = random.Random(3)

    def tree(depth):
        tag = rng.choice(("div", "p2", "span"))
        return f"<{tag}>{'x' if rng.random() < 0.3 else ''}" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)) + f"</{tag}>"

    nodes = dom.nodes(spark.createDataFrame([(i, "".join(tree(3) for _ in range(3))) for i in range(6)], "page_id long, html string")).cache()
    chain = layout.chains(nodes).cache()
    one, two = nodes.select("page_id", F.col("node_id").alias("a")), nodes.select("page_id", F.col("node_id").alias("b"))
    want = layout.tree_distance(one.join(two, "page_id").filter("a < b"), chain).filter(F.col("distance") < options.APART)
    want = {(r.page_id, r.a, r.b) for r in want.collect()}
    got = [(r.page_id, r.a, r.b) for r in options.near_pairs(nodes, chain).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
    groups = {(r.page_id, r.node_id): r.group for r in options.grouped(nodes, options.near_pairs(nodes, chain)).collect()}
    assert len(groups) == nodes.count() and all(groups[p, a] == groups[p, b] for p, a, b in want)
    assert all(groups[p, g] == g <= k for (p, k), g in groups.items())
