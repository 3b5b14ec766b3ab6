"""DOM operators on static HTML: node tables, block segments, links, and relations between nodes.

Pages are parsed by a lenient parser in Arrow batches, one row a node. Layout isn't in static HTML:
operators that need rectangles or styles take them as columns (see `functions.measures`), else nodes
count as shown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that segments leave out, and those that make a segment.
IGNORED = frozenset("script style noscript br hr".split())
SEGMENT_BLOCKS = frozenset("div section article aside nav header footer main form fieldset table".split())
#: Elements that end an open paragraph, for parsing alone.
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split())
#: A new one of these ends an open one of the group.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}


class Tree(HTMLParser):
    """Nodes in document order, each with the numbers of its last descendant, of its pieces of text, and of the siblings (elements,
    comments and texts that aren't blank) before it. Linear in the page: open nodes count their children by tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.top = {"by_tag": {}, "slots": 0, "in_text": False}

    def _slot(self, text: bool) -> int:
        """The place of a new child of the open node; pieces of one text share a place."""
        up = self.nodes[self.open[-1]] if self.open else self.top
        if not (text and up["in_text"]):
            up["slots"] += 1
        up["in_text"] = text
        return up["slots"] - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = CLOSES.get(tag, set())
        if self.open and self.nodes[self.open[-1]]["tag"] in (ends or ({"p"} if tag in BLOCKS else set())):
            self._close(len(self.open) - 1)
        parent = self.open[-1] if self.open else -1
        up = self.nodes[parent] if parent >= 0 else self.top
        nth = up["by_tag"][tag] = up["by_tag"].get(tag, 0) + 1
        before, me = self._slot(False), len(self.nodes)
        path = (up["path"] if parent >= 0 else "") + f"/{tag}[{nth}]"
        self.nodes.append({"tag": tag, "parent": parent, "path": path, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "depth": len(self.open), "end": me, "own": [], "first": len(self.pieces), "last": len(self.pieces), "before": before, "by_tag": {}, "slots": 0, "in_text": False})
        if parent >= 0:
            up["kids"].append(me)
        if tag not in VOID:
            self.open.append(me)

    def _close(self, k: int) -> None:
        """Close the open nodes from the k-th on."""
        for n in self.open[k:]:
            self.nodes[n]["end"], self.nodes[n]["last"] = len(self.nodes) - 1, len(self.pieces)
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._slot(True)
        if self.open and self.nodes[self.open[-1]]["tag"] not in IGNORED:
            if data.strip():
                self.nodes[self.open[-1]]["own"].append(data)
            self.pieces.append(data)

    def handle_comment(self, data: str) -> None:
        self._slot(False)


class Nodes(list):
    """A page's nodes, and its pieces of text in document order."""

    pieces: list[str]
    slots: int


def parse(html: str | None) -> Nodes:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    tree._close(0)
    out = Nodes(tree.nodes)
    out.pieces, out.slots = tree.pieces, tree.top["slots"]
    return out


def inner_texts(nodes: Nodes) -> list[str]:
    """Each node's own and descendants' text in document order."""
    return [" ".join("".join(nodes.pieces[n["first"] : n["last"]]).split()) for n in nodes]


#: Bytes of pages that a worker takes at a time, and rows and letters of pages whose nodes it holds at a time.
INPUT_BYTES, BATCH_ROWS, BATCH_CHARS = 4 << 20, 2000, 1 << 18


def batched(batches: Iterator[pa.RecordBatch], rows_of, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of each page, given out in batches of BATCH_ROWS rows or BATCH_CHARS letters of pages, and of a page at least."""
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)
    rows, chars = [], 0
    for batch in batches:
        for page, html in zip(batch.column(0), batch.column(1)):
            page, html = page.as_py(), html.as_py()
            rows += [(page, *r) for r in rows_of(parse(html))]
            chars += len(html or "")
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield pack(rows)
                rows, chars = [], 0
    yield pack(rows)


def _per_page(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    bound_batches(pages.sparkSession, INPUT_BYTES)
    out = pa.schema(_arrow(schema))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(lambda batches: batched(batches, rows_of, out), schema)


def _arrow(schema: str) -> list:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return [pa.field(*(lambda n, t: (n, kinds[t]))(*f.split(" ", 1))) for f in schema.split(", ")]


NODES = "page_id long, node_id long, parent_id long, end_id long, depth long, tag string, path string, attrs map<string,string>, own_text boolean, said string, before long, after long, text string"


def nodes(pages: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """page_id, node_id (from 0, in document order), parent_id (-1 none), end_id (last node below; itself if none), depth, tag, path, attrs,
    own_text (whether it has a text of its own), said (its own texts, in lines), before and after (siblings that aren't blank), and text (own and below);
    columns `without` which the caller does are left out, and cost nothing."""
    fields = [f for f in NODES.split(", ") if f.split(" ")[0] not in without]
    kept = [k for k, f in enumerate(NODES.split(", ")[1:]) if f in fields]

    def of(ns: Nodes) -> list[tuple]:
        after = [(ns[n["parent"]]["slots"] if n["parent"] >= 0 else ns.slots) - n["before"] - 1 for n in ns]
        texts = inner_texts(ns) if "text" not in without else [""] * len(ns)
        rows = ((k, n["parent"], n["end"], n["depth"], n["tag"], n["path"], list(n["attrs"].items()), bool(n["own"]), "\n".join(n["own"]), n["before"], x, t) for k, (n, x, t) in enumerate(zip(ns, after, texts)))
        return [tuple(r[k] for k in kept) for r in rows]

    return _per_page(pages, of, ", ".join(fields))


def _segments(ns: list[dict]) -> list[tuple]:
    """Blocks with text that hold no smaller block with text."""
    texts = inner_texts(ns)
    inner = [False] * len(ns)
    for k in range(len(ns) - 1, -1, -1):
        block = ns[k]["tag"] in SEGMENT_BLOCKS and texts[k] != ""
        if ns[k]["parent"] >= 0:
            inner[ns[k]["parent"]] |= block or inner[k]
    return [(k, n["tag"], n["path"], texts[k], len(n["kids"])) for k, n in enumerate(ns) if n["tag"] in SEGMENT_BLOCKS and texts[k] and not inner[k] and n["tag"] not in IGNORED]


def segments(pages: DataFrame) -> DataFrame:
    return _per_page(pages, _segments, "page_id long, node_id long, tag string, path string, text string, n_children long")


def links(pages: DataFrame) -> DataFrame:
    """page_id, href, text, title of anchors with an href; of equal hrefs the one of the longest text (its
    stand-in for area), the first of several."""

    def of(ns: list[dict]) -> list[tuple]:
        best: dict[str, tuple] = {}
        for n, t in zip(ns, inner_texts(ns)):
            href = n["attrs"].get("href", "")
            if n["tag"] == "a" and href and (href not in best or len(t) > len(best[href][1])):
                best[href] = (href, t, n["attrs"].get("title", ""))
        return list(best.values())

    return _per_page(pages, of, "page_id long, href string, text string, title string")


def without_nested(df: DataFrame, page: str = "page_id", path: str = "path") -> DataFrame:
    """Nodes that hold no other listed node: a path that begins another is dropped."""
    held = df.select(F.col(page).alias("_p"), F.col(path).alias("_own"), F.explode(_ancestors(F.col(path))).alias("_a")).filter("_a <> _own").select("_p", "_a").distinct()
    return df.join(held, (F.col(page) == F.col("_p")) & (F.col(path) == F.col("_a")), "left_anti")


def _ancestors(path: Column) -> Column:
    """The paths of all ancestors."""
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 2, F.lit(0))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, k + 1), "/")))


def tree_distance(one: Column, two: Column) -> Column:
    """Steps from one path up to the common ancestor and down to the other."""
    a, b = (F.filter(F.split(c, "/"), lambda s: s != "") for c in (one, two))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k)))
    return F.size(a) + F.size(b) - 2 * same


def shown(tag: Column, attrs: Column) -> Column:
    """Shown as far as tag and attributes tell."""
    style = F.coalesce(F.element_at(attrs, "style"), F.lit(""))
    hidden = style.rlike("(?i)(display\\s*:\\s*none|visibility\\s*:\\s*hidden)") | F.map_contains_key(attrs, "hidden") | (F.lower(F.coalesce(F.element_at(attrs, "type"), F.lit(""))) == "hidden")
    return ~tag.isin(sorted(IGNORED | {"head", "title", "meta", "link"})) & ~hidden


def interactable(tag: Column, attrs: Column) -> Column:
    return tag.isin("a", "button", "input", "select", "textarea", "option") & ~F.map_contains_key(attrs, "disabled")


def search_forms(node_table: DataFrame) -> DataFrame:
    """Forms whose attributes name a search."""
    from .scoring import SEARCH

    return node_table.filter((F.col("tag") == "form") & F.exists(F.map_values("attrs"), lambda v: v.rlike(f"(?i){SEARCH}")))


def _below(ns: list[dict], top: int) -> Iterator[int]:
    """Nodes below one, in document order."""
    ahead = ns[top]["kids"][::-1]
    while ahead:
        k = ahead.pop()
        yield k
        ahead += ns[k]["kids"][::-1]


def search_handles(pages: DataFrame) -> DataFrame:
    """page_id and the paths of a page's search form, its text box and its button (null without one); no row
    without a text box. The form is the first one whose id, class, action, name or role names a search, and its
    last box and button count. Else it is the last form with a box whose own attributes do, with the first such
    box and the form's first button."""
    import re

    from .scoring import SEARCH

    def names(node: dict, attrs: str) -> bool:
        return any(re.search(SEARCH, node["attrs"].get(a, ""), re.I) for a in attrs.split())

    def box(node: dict) -> bool:
        return node["tag"] == "input" and (node["attrs"].get("type") or "text").lower() in ("text", "search")

    def button(node: dict) -> bool:
        return node["tag"] == "button" or node["tag"] == "input" and node["attrs"].get("type", "").lower() == "submit"

    def of(ns: list[dict]) -> list[tuple]:
        forms = [k for k, n in enumerate(ns) if n["tag"] == "form"]
        named = [k for k in forms if names(ns[k], "id class action name role")]
        if named:
            form, chosen = named[0], None
            boxes = [k for k in _below(ns, form) if box(ns[k])]
            chosen = boxes[-1] if boxes else None
            buttons = [k for k in _below(ns, form) if button(ns[k])][-1:]
        else:
            found = [(k, b) for k in forms for b in [next((b for b in _below(ns, k) if box(ns[b]) and names(ns[b], "id class title value placeholder")), None)] if b is not None]
            form, chosen = found[-1] if found else (None, None)
            buttons = [k for k in _below(ns, form) if button(ns[k])][:1] if found else []
        return [(ns[form]["path"], ns[chosen]["path"], ns[buttons[0]]["path"] if buttons else None)] if chosen is not None else []

    return _per_page(pages, of, "page_id long, form string, box string, button string")


def select_options(pages: DataFrame) -> DataFrame:
    """page_id, the path of each select that has a text and whose selected option (the first, if none is marked)
    isn't 1, and of its options, with their text; options that ask to select or choose are left out."""

    def of(ns: list[dict]) -> list[tuple]:
        texts, out = inner_texts(ns), []
        for k, n in enumerate(ns):
            options = [o for o in _below(ns, k) if ns[o]["tag"] == "option"] if n["tag"] == "select" else []
            marked = [o for o in options if "selected" in ns[o]["attrs"]] or options
            if options and texts[k] and texts[marked[0]] != "1":
                out += [(n["path"], ns[o]["path"], texts[o]) for o in options if not any(w in texts[o].upper() for w in ("SELECT", "CHOOSE"))]
        return out

    return _per_page(pages, of, "page_id long, path string, option string, text string")


def trigger_lists(triggers: DataFrame, lists: DataFrame) -> DataFrame:
    """page_id, trigger and list of each list that the trigger or one of its siblings holds or is; both frames have
    page_id and path. Such a list lies below the trigger's parent, so this is an equi-join on the lists' ancestors;
    triggers without a parent have no siblings here and no lists."""
    above = lists.select("page_id", F.col("path").alias("list"), F.explode(F.array_distinct(_ancestors(F.col("path")))).alias("parent")).filter("parent <> list")
    below = triggers.select("page_id", F.col("path").alias("trigger"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent")).filter("parent <> ''")
    return below.join(above, ["page_id", "parent"]).select("page_id", "trigger", "list")


def popup_container(df: DataFrame, page: str, z_index: str, order: str) -> DataFrame:
    """The node of largest z-index a page, the first of several."""
    from .relational import keep_first

    return keep_first(df.filter(F.col(z_index) > 0), [page], [F.col(z_index).desc(), F.col(order)])


def option_combinations(df: DataFrame, lists: list[str], name: str = "combination") -> DataFrame:
    """One row for each choice of one element from every array column."""
    for k, c in enumerate(lists):
        df = df.withColumn(f"_c{k}", F.explode(c))
    return df.withColumn(name, F.array(*(F.col(f"_c{k}") for k in range(len(lists))))).drop(*(f"_c{k}" for k in range(len(lists))))


def content_vectors(pages: DataFrame) -> DataFrame:
    """page_id, node_id and a vector of text length, links, images and inputs of each node and below."""

    def of(ns: list[dict]) -> list[tuple]:
        own = [[0, int(n["tag"] == "a"), int(n["tag"] == "img"), int(n["tag"] in ("input", "select", "textarea", "button"))] for n in ns]
        for k in range(len(ns) - 1, -1, -1):
            if ns[k]["parent"] >= 0:
                own[ns[k]["parent"]] = [a + b for a, b in zip(own[ns[k]["parent"]], own[k])]
        return [(k, len(t), *v[1:]) for k, (t, v) in enumerate(zip(inner_texts(ns), own))]

    wide = _per_page(pages, of, "page_id long, node_id long, n_text long, n_links long, n_images long, n_inputs long")
    return wide.select("page_id", "node_id", F.array(*(F.col(c).cast("double") for c in ("n_text", "n_links", "n_images", "n_inputs"))).alias("content"))


def sibling_similarity(node_table: DataFrame, content: DataFrame) -> DataFrame:
    """page_id, parent_id, number of pairs of its children and their mean cosine, without the pairs: over unit vectors u the sum of
    all pairs' cosines is (|sum u|^2 - sum |u|^2) / 2; a null vector's cosines are 0."""
    kids = node_table.filter("parent_id >= 0").select("page_id", "parent_id", "node_id").join(content, ["page_id", "node_id"])
    norm = F.sqrt(F.aggregate("content", F.lit(0.0), lambda s, x: s + x * x))
    unit = kids.withColumn("norm", norm).withColumn("u", F.transform("content", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))))
    places = unit.select("page_id", "parent_id", (F.col("norm") > 0).alias("real"), *(F.col("u")[k].alias(f"u{k}") for k in range(4)))
    sums = places.groupBy("page_id", "parent_id").agg(F.count("*").alias("n"), F.count_if("real").alias("n_real"), *(F.sum(f"u{k}").alias(f"s{k}") for k in range(4)))
    square = sum((F.col(f"s{k}") * F.col(f"s{k}") for k in range(4)), F.lit(0.0))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return sums.filter("n > 1").select("page_id", "parent_id", pairs.alias("n_pairs"), ((square - F.col("n_real")) / 2 / pairs).alias("similarity"))


def similar_blocks(node_table: DataFrame, content: DataFrame, most: float = 0.8) -> DataFrame:
    """Segments by similarity: nodes whose children differ (mean similarity at most `most`) are split,
    so a segment is a shown node all of whose ancestors are split while itself it isn't."""
    from .layout import below

    like = sibling_similarity(node_table, content)
    split = like.filter(F.col("similarity") <= most).select("page_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("split"))
    marked = node_table.join(split, ["page_id", "node_id"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    inside = marked.withColumn("_inside", below(~F.col("split")))
    return inside.filter("NOT split AND NOT _inside").filter(shown(F.col("tag"), F.col("attrs"))).drop("split", "_inside")
