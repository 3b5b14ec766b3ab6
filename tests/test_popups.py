"""Popup containers and close buttons, against the walk over each tree."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dom, popups

COLUMNS = "shown boolean, positioned boolean, z long, width double, height double, centred boolean"


def page(seed):
    rng = random.Random(seed)

    def element(depth):
        tag = rng.choice(["div", "div", "div", "span", "button", "a", "img", "iframe"])
        attrs = rng.choice(["", 'class="btn-close"', 'href="/close/x"', 'aria-label="Dismiss"', 'id="x"'])
        if tag in ("img", "iframe"):
            return f"<{tag} {attrs}></{tag}>"
        inside = "".join(rng.choice([element(depth + 1), element(depth + 1), "YES please ", "words "]) for _ in range(rng.randint(0, 3))) if depth < 7 else rng.choice(["Yes", "x"])
        return f"<{tag} {attrs}>{inside}</{tag}>"

    return "<html><head></head><body>" + "".join(element(0) for _ in range(3)) + "</body></html>"


@pytest.fixture(scope="module")
def world(spark):
    pages = {i: page(i) for i in range(400)}
    trees, rows = {}, []
    for p, html in pages.items():
        rng, trees[p] = random.Random(p), dom.parse(html)
        for k, n in enumerate(trees[p]):
            n.update(shown=rng.random() < 0.9, positioned=rng.random() < 0.9, z=rng.choice([None, None, 1, 2, 3, -1]), width=rng.choice([100.0, 200.0, 300.0]), height=200.0, centred=rng.random() < 0.9)
            rows.append((p, k, *(n[c.split()[0]] for c in COLUMNS.split(", "))))
    nodes = dom.nodes(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    return trees, nodes.join(spark.createDataFrame(rows, f"page_id long, node_id long, {COLUMNS}"), ["page_id", "node_id"]).cache()


def above(ns, k):
    while ns[k]["parent"] >= 0:
        k = ns[k]["parent"]
        yield k


def container(ns):
    at = next(k for k, n in enumerate(ns) if n["tag"] == "body")
    divs = [k for k, n in enumerate(ns) if n["tag"] == "div" and n["shown"] and n["positioned"] and (n["z"] or 0) > 0 and n["centred"] and n["width"] > 150 and n["height"] > 150]
    found = None
    while divs:
        free = []
        for k in divs:
            between = []
            for a in above(ns, k):
                if a == at:
                    break
                between.append(a)
            if all(ns[a]["z"] is None for a in between):
                free.append(k)
        if not free:
            break
        best = max(ns[k]["z"] for k in free)
        at = found = next(k for k in free if ns[k]["z"] == best)
        divs = [k for k in divs if at in above(ns, k)]
    if found is not None and len(ns[found]["kids"]) == 1 and ns[ns[found]["kids"][0]]["tag"] == "iframe":
        found = ns[found]["kids"][0]
    return found


def test_containers_and_close_buttons(world):
    trees, nodes = world
    found = popups.popup_containers(nodes)
    want = {p: container(ns) for p, ns in trees.items()}
    assert {r.page_id: r.node_id for r in found.collect()} == {p: k for p, k in want.items() if k is not None}
    assert sum(k is not None for k in want.values()) > 10
    buttons = set()
    for p, top in want.items():
        ns = trees[p]
        if top is None:
            continue
        says = lambda n: any(any(w in v for w in popups.CLOSING_ATTRIBUTES) and "/" not in v for v in n["attrs"].values()) or any(w in t for t in n["own"] for w in popups.CLOSING_TEXTS)
        listed = [k for k, n in enumerate(ns) if n["tag"] in popups.CLOSING_TAGS and n["shown"] and top in above(ns, k) and says(n)]
        listed = [k for k in listed if ns[k]["tag"] == "button" or not any(a in listed and ns[a]["tag"] == "button" for a in above(ns, k))]
        buttons |= {(p, k) for k in listed if not any(k in above(ns, j) for j in listed)}
    got = {(r.page_id, r.node_id) for r in popups.close_buttons(nodes, found).collect()}
    assert got == buttons and len(buttons) > 8


def test_without_holders_keeps_leaves(world):
    trees, nodes = world
    got = {(r.page_id, r.node_id) for r in popups.without_holders(nodes.filter(F.col("tag").isin("div", "span"))).collect()}
    listed = {(p, k) for p, ns in trees.items() for k, n in enumerate(ns) if n["tag"] in ("div", "span")}
    assert got == {(p, k) for p, k in listed if not any((p, j) in listed and k in above(trees[p], j) for j in range(k + 1, len(trees[p])))}
