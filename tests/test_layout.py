"""Path steps, tree distance and segments by layout, against recursion over the same trees."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dom, layout

SIZE = {"left": "double", "top": "double", "width": "double", "height": "double", "shown": "boolean"}


def random_page(seed):
    rng = random.Random(seed)

    def element(depth):
        tag = rng.choice(["div", "section", "p", "span", "a", "ul", "li", "table", "script", "b"])
        inside = "".join(rng.choice([element(depth + 1), "text ", "\n ", "<!-- c -->"]) for _ in range(rng.randint(0, 4))) if depth < 6 else "leaf"
        return f'<{tag} class="{rng.choice(["x", "y z", "w"])}" {rng.choice(["", "id=q"])}>{inside}</{tag}>'

    return "<html><body>" + "".join(element(0) for _ in range(5)) + "</body></html>"


@pytest.fixture(scope="module")
def pages():
    return {i: random_page(i) for i in range(60)}


@pytest.fixture(scope="module")
def trees(pages):
    """By page: nodes with kids, rectangles and own text, for the recursions."""
    out = {}
    for page, html in pages.items():
        ns, rng = dom.parse(html), random.Random(page)
        for k, n in enumerate(ns):
            n["id"], n["shown"] = k, rng.random() > 0.05
            small = rng.random() < 0.05
            n["left"], n["top"], n["width"], n["height"] = float(rng.randint(0, 300)), float(rng.randint(0, 300)), 1.0 if small else float(rng.randint(0, 200)), 1.0 if small else float(rng.randint(0, 200))
        out[page] = ns
    return out


@pytest.fixture(scope="module")
def node_table(spark, pages, trees):
    df = dom.nodes(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    sized = spark.createDataFrame([(p, k, *(n[c] for c in SIZE)) for p, ns in trees.items() for k, n in enumerate(ns)], "page_id long, node_id long, " + ", ".join(f"{c} {t}" for c, t in SIZE.items()))
    return df.join(sized, ["page_id", "node_id"]).cache()


def down(ns, k):
    for c in ns[k]["kids"]:
        yield c
        yield from down(ns, c)


def test_numbering(node_table, trees):
    for r in node_table.collect():
        ns = trees[r.page_id]
        assert r.end_id == max([r.node_id, *down(ns, r.node_id)])
        assert r.text == " ".join(r.text.split())


STEPS = {
    "//div//a": [("descendant", "div", ()), ("descendant", "a", ())],
    "/html/body/*[2]": [("child", "html", ()), ("child", "body", ()), ("child", "*", (2,))],
    "//*[contains(@class,'y')]/..": [("descendant", "*", (("class", "y"),)), ("parent", "*", ())],
    "//div[@id]/p[last()]": [("descendant", "div", ("id",)), ("child", "p", (-1,))],
    "//*/b[contains(@class,'x')][1]": [("descendant", "*", ()), ("child", "b", (("class", "x"), 1))],
    "//section/../div[1]": [("descendant", "section", ()), ("parent", "*", ()), ("child", "div", (1,))],
}


def brute_steps(ns, steps):
    here = None
    for axis, tag, tests in steps:
        if axis == "descendant":
            pool = set(range(len(ns))) if here is None else {d for k in here for d in down(ns, k)}
        elif axis == "child":
            pool = {k for k, n in enumerate(ns) if n["parent"] < 0} if here is None else {c for k in here for c in ns[k]["kids"]}
        else:
            pool = {ns[k]["parent"] for k in here} - {-1}
        pool = {k for k in pool if tag == "*" or ns[k]["tag"] == tag}
        for t in tests:
            if isinstance(t, int):
                by = {}
                for k in sorted(pool):
                    by.setdefault(ns[k]["parent"], []).append(k)
                pool = {v[t - 1 if t > 0 else t] for v in by.values() if len(v) >= abs(t)}
            else:
                name, part = t if isinstance(t, tuple) else (t, "")
                pool = {k for k in pool if name in ns[k]["attrs"] and part in ns[k]["attrs"][name]}
        here = pool
    return here


@pytest.mark.parametrize("path", STEPS)
def test_steps(node_table, trees, path):
    test = lambda t: t if isinstance(t, int) else layout.has_part(*t) if isinstance(t, tuple) else layout.has(t)
    got = layout.follow(node_table, [layout.Step(a, t, tuple(map(test, ts))) for a, t, ts in STEPS[path]])
    want = {(p, k) for p, ns in trees.items() for k in brute_steps(ns, STEPS[path])}
    assert want and sorted((r.page_id, r.node_id) for r in got.collect()) == sorted(want)


def brute_distance(ns, a, b):
    if a == b:
        return 0.0

    def chain(k):
        return ([] if ns[k]["parent"] < 0 else chain(ns[k]["parent"])) + [k]

    left, right = chain(min(a, b)), chain(max(a, b))
    while left and right and left[0] == right[0]:
        left, right = left[1:], right[1:]
    if not left or not right:
        return layout.CONTAINED
    slots = lambda k: ns[ns[k]["parent"]]["slots"] if ns[k]["parent"] >= 0 else ns.slots
    cost = 1.0
    for i in range(max(len(left), len(right))):
        l, r = (left[i] if i < len(left) else None), (right[i] if i < len(right) else None)
        cost += 2 if l is None or r is None or ns[l]["tag"] != ns[r]["tag"] else 1
        if i == 0:
            cost += ns[r]["before"] - ns[l]["before"] - 1
        else:
            cost += (slots(l) - ns[l]["before"] - 1 if l is not None else 0) + (ns[r]["before"] if r is not None else 0)
    return cost


def test_tree_distance(spark, node_table, trees):
    rng = random.Random(0)
    pairs = [(p, rng.randrange(len(ns)), rng.randrange(len(ns))) for p, ns in trees.items() for _ in range(40)]
    got = layout.tree_distance(spark.createDataFrame(pairs, "page_id long, a long, b long"), layout.chains(node_table)).collect()
    assert sorted((r.page_id, r.a, r.b, r.distance) for r in got) == sorted((p, a, b, brute_distance(trees[p], a, b)) for p, a, b in pairs)


def test_distance_counts_strides(spark):
    html = "<ul><li><a>1</a></li>words<li></li> <li>x<b></b><a>2</a></li></ul>"
    nodes = dom.nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).cache()
    a, b = [r.node_id for r in nodes.filter("tag = 'a'").orderBy("node_id").collect()]
    (r,) = layout.tree_distance(spark.createDataFrame([(1, b, a)], "page_id long, a long, b long"), layout.chains(nodes)).collect()
    # ul 1; li and li 1, between them a text and an li 2; a and a 1, before the second a text and a b 2
    assert r.distance == 1 + 1 + 2 + 1 + 2


def hidden(n):
    return n["tag"] in dom.IGNORED or not n["shown"] or (n["width"] == 1 and n["height"] == 1)


def brute_blocks(ns, k, window):
    n, kids = ns[k], ns[k]["kids"]
    inside = lambda: [s for c in kids for s in brute_blocks(ns, c, window)]
    if hidden(n):
        return []
    large = n["width"] * n["height"] / window > 0.3
    if n["tag"] in dom.SEGMENT_BLOCKS:
        if not any(ns[d]["tag"] in dom.SEGMENT_BLOCKS and ns[d]["shown"] for d in down(ns, k)):
            if kids and all(ns[c]["tag"] in dom.IGNORED for c in kids):
                return []
            return inside() if large else [k]
        return [k] if n["own"] else inside()
    if any(ns[d]["tag"] == "div" for d in down(ns, k)):
        return inside()
    return inside() if large else [k]


def test_block_segments(node_table, trees):
    got = sorted((r.page_id, r.node_id) for r in layout.block_segments(node_table, 40_000.0).collect())
    want = sorted((p, s) for p, ns in trees.items() for k, n in enumerate(ns) if n["parent"] < 0 for s in brute_blocks(ns, k, 40_000.0))
    assert got == want and len(want) > 30


def brute_like(ns, k, content, measure):
    n = ns[k]
    if hidden(n):
        return []
    kids = [c for c in n["kids"] if ns[c]["shown"] and not (ns[c]["width"] == 1 and ns[c]["height"] == 1)]
    holds = any(ns[c]["tag"] in dom.SEGMENT_BLOCKS or any(ns[d]["tag"] in dom.SEGMENT_BLOCKS for d in down(ns, c)) for c in kids)
    if n["tag"] not in dom.SEGMENT_BLOCKS or not holds or (n["own"] and n["tag"] != "body"):
        return [k]
    import numpy as np

    x = {c: np.array([ns[j][c] for j in kids]) for c in ("left", "top", "width", "height")}
    degree, like = measure(x["left"], x["top"], x["left"] + x["width"], x["top"] + x["height"], np.array([content[j] for j in kids], float))
    if len(kids) == 1 or degree <= 0.8 or like <= 0.8:
        return [s for c in kids for s in brute_like(ns, c, content, measure)]
    return [k]


def test_similarity_segments(spark, pages, node_table, trees):
    vectors = dom.content_vectors(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    content = {(r.page_id, r.node_id): r.content for r in vectors.collect()}
    got = sorted((r.page_id, r.node_id) for r in layout.similarity_segments(node_table, vectors).collect())
    want = sorted((p, s) for p, ns in trees.items() for k, n in enumerate(ns) if n["parent"] < 0 for s in brute_like(ns, k, {j: content[p, j] for j in range(len(ns))}, layout.seams))
    assert got == want


def test_seams():
    import numpy as np

    one = lambda *r: [np.array(c, float) for c in zip(*r)]
    content = np.ones((2, 2))
    assert layout.seams(*one((0, 0, 100, 10), (0, 20, 100, 30)), content) == (1.0, 1.0)  # one above the other, equal widths
    assert layout.seams(*one((0, 0, 100, 10), (60, 20, 110, 30)), content) == (0.3, 1.0)  # 40 in common: 40 * 40 / (100 * 50)
    assert layout.seams(*one((0, 0, 10, 10), (20, 20, 30, 30)), content) == (0.0, 0.0)  # they don't face each other
    three = layout.seams(*one((0, 0, 100, 10), (0, 20, 100, 30), (0, 40, 100, 50)), np.array([[1.0, 0], [0, 1], [1, 0]]))
    assert three == (1.0, 0.0)  # the middle one lies between the others, so two pairs


def test_wide_pages_parse_in_linear_time():
    import time

    began = time.time()
    dom.inner_texts(dom.parse("<ul>" + "<li>x</li>" * 60_000 + "</ul>" + "<b>y</b>" * 20_000))
    assert time.time() - began < 10


def test_sibling_similarity_is_the_mean_of_pairs(spark, pages, node_table):
    import numpy as np

    vectors = dom.content_vectors(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    content = {(r.page_id, r.node_id): np.array(r.content) for r in vectors.collect()}
    kids = {}
    for r in node_table.filter(F.col("parent_id") >= 0).collect():
        kids.setdefault((r.page_id, r.parent_id), []).append(content[r.page_id, r.node_id])
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    want = {k: np.mean([unit(a) @ unit(b) for i, a in enumerate(v) for b in v[i + 1 :]]) for k, v in kids.items() if len(v) > 1}
    got = {(r.page_id, r.parent_id): r.similarity for r in dom.sibling_similarity(node_table, vectors).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
