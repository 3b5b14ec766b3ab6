"""Product options of shop pages: toggles, selects and lists that a trigger opens, over node tables with computed styles.

Columns beside those of `dom.nodes`: shown, left, top, width, height, border (has a border or a shadow of its own), display and float
(of its style), and fixed (its position). Null styles count as absent; pages without options have no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import latin1_only
from ..session import Scratch
from . import dom
from .layout import chains, counted_below, of_parent, tree_distance
from .popups import without_holders

# What the text or the classes of something say that is no option; where links of something lead that is none.
NO_OPTION = (
    "instagram", "youtube", "twitter", "facebook", "login", "log in", "signup", "sign up", "signin", "sign in", "pinterest", "email", "share",
    "account", "add ", "review", "submit", "related", "show ", "shop ", "upload ", "code ", "view details", "choose options", "cart", "loading",
    "cancel", "view all", "description", "additional information", "ship ", "$", "%", "save as", "out ", "wishlist", "increment", "buy", "shipping",
    "availability", "decrement", "pick ", "video", "plus", "minus", "quantity", "slide", "address", "learn more", "at ", "reserve", "save", "pickup",
    "favorite", "gift", "registry", "larger ", "guide", "seeds", "stars", "compare", "linkedin", "chat", "notify ", "order ", " order", "question",
    "upsell", "looking for ", "get free demo", "wish list", "more information", "delivery", "back", "in-store", "trustpilot", "newsletter",
    "custom size", "chart", "affiliate",
)
NO_TARGET = ("facebook", "linkedin", "twitter", "blogger", "instagram", "youtube", "email", "tumblr", "google", "pinterest", "wishlist", "sendfriend", "trustpilot", "newsletter")
# Elements that a toggle doesn't hold.
HELD_BY_NONE = ("select", "form", "iframe", "style", "dl", "ol", "ul", "table")
#: Toggles nearer than this in the tree are one group.
APART = 4


def says_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return F.coalesce(out, F.lit(False))


def located(window: float) -> Column:
    """In the part of the window where a product's options stand."""
    return (F.col("left") >= 0.3 * window) & (F.col("left") <= window) & (F.col("top") >= 205) & (F.col("top") <= 900) & (F.col("left") + F.col("width") <= 0.9 * window)


def sized(height: tuple[float, float], width: tuple[float, float]) -> Column:
    return (F.col("height") > height[0]) & (F.col("height") < height[1]) & (F.col("width") > width[0]) & (F.col("width") < width[1])


def _of(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", name), F.lit(""))


def toggle_nodes(nodes: DataFrame, window: float) -> DataFrame:
    """The nodes that are toggles: all columns of `nodes`, innermost ones alone (a list item stays before what it holds)."""
    odd_input = (F.col("tag") == "input") & ~F.lower(_of("type")).isin("radio", "checkbox")
    marks = {"_lists": F.col("tag").isin("ul", "ol"), "_links": F.col("tag") == "a", "_buttons": F.col("tag") == "button", "_borders": F.coalesce("border", F.lit(False)), "_odd": F.col("tag").isin(*HELD_BY_NONE) | odd_input}
    counted = of_parent(counted_below(nodes, marks), {"display": "_display", "float": "_float"})
    for tag, at in (("a", "_link"), ("button", "_button")):  # the next one in the page is the one below, if one is below
        bare = F.concat_ws(" ", *(F.regexp_replace(_of(n), "^([^%]*)%", "$1") for n in ("href", "onclick", "class")))
        ahead = Window.partitionBy("page_id").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)  # a running value; frames that begin at the row cost the square
        counted = counted.withColumn(at, F.last(F.when(F.col("tag") == tag, bare), ignorenulls=True).over(ahead))
    said = F.lower(F.concat_ws(" ", "text", _of("class"), F.when(F.col("_links") == 1, F.col("_link")), F.when(F.col("_buttons") == 1, F.col("_button"))))
    kind = F.col("tag").isin("label", "a", "span", "div", "button") | ((F.col("tag") == "li") & (F.col("_lists") == 0))
    inline = F.coalesce((F.col("display") == "inline-block") | (F.col("float") == "left"), F.lit(False)) | F.coalesce((F.col("_display") == "flex") | (F.col("_float") == "left"), F.lit(False))
    bordered = F.coalesce("border", F.lit(False)) | (F.col("_borders") > 0)
    few = (F.col("_links") <= 1) & (F.col("_buttons") <= 1) & (F.col("_odd") == 0)
    target = F.concat_ws(" ", _of("href"), _of("src"), _of("onclick"))
    found = counted.filter(kind & few & ~says_any(said, NO_OPTION) & (latin1_only(F.col("text")) != "1") & ~says_any(target, NO_TARGET) & sized((19, 110), (5, 270)) & located(window) & inline & bordered & F.col("shown"))
    return without_holders(found.select(*nodes.columns), "li")


def near_pairs(listed: DataFrame, chain_table: DataFrame) -> DataFrame:
    """page_id, a, b and distance of listed nodes nearer than APART in the tree, neither of which holds the other. By the costs of
    `tree_distance` such a pair's paths part one or two levels above, alike for both, at siblings with at most one other between; from two levels
    above, a is the last and b the first below its parent. So nodes meet by ancestor and place, a few each, and never all in pairs."""
    chain, size = F.col("chain"), F.size("chain")
    levels = F.filter(F.array(F.lit(1), F.lit(2)), lambda up: up <= size)
    at = lambda up: F.get(chain, size - up)
    step = lambda up: F.struct(F.coalesce(at(up + 1)["id"], F.lit(-1)).alias("above"), up.alias("up"), at(up)["before"].alias("place"), at(1)["before"].alias("before"), at(1)["after"].alias("after"))
    steps = listed.select("page_id", "node_id").join(chain_table.hint("merge"), ["page_id", "node_id"]).select("page_id", "node_id", F.explode(F.transform(levels, step)).alias("s")).select("page_id", "node_id", "s.*")
    left = steps.filter("up = 1 OR after = 0").select("page_id", F.col("node_id").alias("a"), "above", "up", F.explode(F.array(F.col("place") + 1, F.col("place") + 2)).alias("place"))
    right = steps.filter("up = 1 OR before = 0").select("page_id", F.col("node_id").alias("b"), "above", "up", "place")
    pairs = left.join(right, ["page_id", "above", "up", "place"]).select("page_id", "a", "b")
    return tree_distance(pairs, chain_table).select("page_id", "a", "b", "distance").filter(F.col("distance") < APART)


def grouped(listed: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_id, node_id and group (its first node) of listed nodes: components of a page's pairs. One page's pairs, a few a node, meet in a task."""

    def roots(page: pd.DataFrame) -> pd.DataFrame:
        top = {int(v): int(v) for v in set(page["a"]) | set(page["b"])}

        def find(v: int) -> int:
            while top[v] != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        for a, b in zip(page["a"].tolist(), page["b"].tolist()):
            one, two = sorted((find(a), find(b)))
            top[two] = one
        return pd.DataFrame({"page_id": page["page_id"].iloc[0], "node_id": list(top), "group": [find(v) for v in top]})

    found = pairs.select("page_id", "a", "b").groupBy("page_id").applyInPandas(roots, "page_id long, node_id long, group long")
    return listed.select("page_id", "node_id").join(found, ["page_id", "node_id"], "left").withColumn("group", F.coalesce("group", "node_id"))


def toggles(nodes: DataFrame, window: float) -> DataFrame:
    """page_id, group (its first node), option (a node) and top (of the group's first node). The other shown children of a list join
    the group that begins with one of its items, unless they say what no option does."""
    scratch = Scratch(nodes.sparkSession, "toggles")
    listed = scratch.save(toggle_nodes(nodes, window), "listed")
    chain_table = scratch.save(chains(nodes).join(listed.select("page_id", "node_id").hint("merge"), ["page_id", "node_id"], "left_semi"), "chains")
    of = scratch.save(grouped(listed, near_pairs(listed, chain_table)), "groups")
    own = of.select("page_id", "group", F.col("node_id").alias("option"))
    firsts = nodes.select("page_id", F.col("node_id").alias("group"), "top", F.when(F.col("tag") == "li", F.col("parent_id")).alias("parent_id"))
    held = own.select("page_id", "group").distinct().join(firsts, ["page_id", "group"])
    others = nodes.filter(F.col("shown") & ~says_any(F.lower("text"), NO_OPTION)).select("page_id", "parent_id", F.col("node_id").alias("option"))
    added = held.join(others, ["page_id", "parent_id"]).select("page_id", "group", "option")
    return own.unionByName(added).distinct().join(held.select("page_id", "group", "top"), ["page_id", "group"])


def selects(nodes: DataFrame, window: float) -> DataFrame:
    """page_id, group (the select), option and top: shown selects with a text whose selected option (the first, if none is marked) isn't 1;
    options that ask to select or choose are left out."""
    boxes = nodes.filter((F.col("tag") == "select") & F.col("shown") & (F.col("text") != "") & located(window) & (F.col("height") > 5) & (F.col("width") > 5) & (F.col("width") < window))
    above = nodes.filter("tag = 'option'").select("page_id", F.col("node_id").alias("option"), "attrs", "text", F.explode(dom._ancestors(F.col("path"))).alias("path"))
    held = above.join(boxes.select("page_id", "path", F.col("node_id").alias("group"), "top"), ["page_id", "path"]).filter("option <> group")
    first = held.groupBy("page_id", "group").agg(F.min_by("text", F.struct(~F.map_contains_key("attrs", "selected"), "option")).alias("_says")).filter(F.coalesce("_says", F.lit("")) != "1")
    asks = says_any(F.upper("text"), ("SELECT", "CHOOSE"))
    return held.join(first, ["page_id", "group"], "left_semi").filter(~asks).select("page_id", "group", "option", "top")


def opened_lists(nodes: DataFrame, taken: DataFrame, window: float) -> DataFrame:
    """page_id, group (the trigger), list, option and top: children of hidden lists that a trigger or one of its siblings holds. A trigger is an innermost
    small bordered element with a text; none holds a `taken` node (page_id, option) or lies in one."""
    counted = counted_below(nodes, {"_links": F.col("tag") == "a"})
    said = F.col("text")
    found = counted.filter(
        F.col("tag").isin("label", "a", "span", "div", "button") & (F.col("_links") <= 1) & (said != "") & (latin1_only(said) != "1") & ~says_any(F.lower(said), NO_OPTION)
        & sized((10, 100), (5, 600)) & located(window) & F.coalesce("border", F.lit(False)) & ~F.coalesce("fixed", F.lit(False)) & F.col("shown")
    )
    inner = without_holders(found.select(*nodes.columns))
    paths = taken.select("page_id", F.col("option").alias("node_id")).distinct().join(nodes.select("page_id", "node_id", "path"), ["page_id", "node_id"]).select("page_id", "path")
    up = lambda df: df.select("page_id", F.explode(F.array_append(dom._ancestors(F.col("path")), F.col("path"))).alias("path"))
    below_taken = inner.select("page_id", "node_id", F.explode(F.array_append(dom._ancestors(F.col("path")), F.col("path"))).alias("path")).join(paths, ["page_id", "path"], "left_semi").select("page_id", "node_id")
    free = inner.join(up(paths).distinct(), ["page_id", "path"], "left_anti").join(below_taken, ["page_id", "node_id"], "left_anti")
    hidden = nodes.filter(F.col("tag").isin("ul", "ol", "dl") & ~F.col("shown"))
    lists = dom.trigger_lists(free, hidden).join(free.select("page_id", F.col("path").alias("trigger"), F.col("node_id").alias("group"), "top"), ["page_id", "trigger"])
    kids = nodes.select("page_id", F.col("parent_id").alias("list_id"), F.col("node_id").alias("option"))
    named = lists.join(hidden.select("page_id", F.col("path").alias("list"), F.col("node_id").alias("list_id")), ["page_id", "list"])
    return named.join(kids, ["page_id", "list_id"]).select("page_id", "group", F.col("list_id").alias("list"), "option", "top")


def product_options(nodes: DataFrame, window: float) -> DataFrame:
    """page_id, kind, group, list (null but for opened lists), option and place: a page's option groups from above (from 1). Opened lists count where a page
    has no selects."""
    scratch = Scratch(nodes.sparkSession, "options")
    of_toggles, of_selects = scratch.save(toggles(nodes, window), "toggles"), scratch.save(selects(nodes, window), "selects")
    opened = opened_lists(nodes, of_toggles, window).join(of_selects.select("page_id").distinct(), "page_id", "left_anti")
    none = F.lit(None).cast("long").alias("list")
    columns = ("page_id", "kind", "group", "list", "option", "top")
    parts = [of_toggles.select("*", F.lit("toggle").alias("kind"), none), of_selects.select("*", F.lit("select").alias("kind"), none), opened.select("*", F.lit("opened").alias("kind"))]
    rows = parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("page_id").orderBy("top", "kind", "group", "list"))).drop("top")
