"""Questions to node tables (`dom.nodes`): path steps, tree distance, and segments by layout.

Nodes are numbered in document order and know the last node below them, so that "below" is a range of numbers: a node lies below
a marked one if the largest end of the marked nodes before it isn't before itself. That is one running maximum over a page, whatever the depth and
the number of marked nodes; no step pairs nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, bound_batches
from .dom import IGNORED, SEGMENT_BLOCKS

def in_page():
    """A page's nodes in document order."""
    return Window.partitionBy("page_id").orderBy("node_id")


def below(marked: Column) -> Column:
    """Whether a node lies below a marked one."""
    end = F.max(F.when(marked, F.col("end_id"))).over(in_page().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(end >= F.col("node_id"), F.lit(False))


def of_parent(nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`nodes` with columns of each node's parent, under new names; null without a parent."""
    up = nodes.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_id"), *(F.col(c).alias(n) for c, n in columns.items()))
    return nodes.join(up.hint("merge"), (F.col("page_id") == F.col("_page")) & (F.col("parent_id") == F.col("_id")), "left").drop("_page", "_id")


# ---------------------------------------------------------------- path steps


@dataclass(frozen=True)
class Step:
    """One step: along `axis` (child, descendant or parent) to nodes of a tag (* any) that pass the tests in turn. A test is a
    condition on the node table, or a number: the place (from 1; -1 the last) among the node's siblings that passed so far."""

    axis: str
    tag: str = "*"
    tests: tuple = field(default=())


def has(name: str, value: str | None = None) -> Column:
    """Has an attribute, with this value."""
    return F.map_contains_key("attrs", name) if value is None else F.coalesce(F.element_at("attrs", name) == value, F.lit(False))


def has_part(name: str, part: str) -> Column:
    """Has an attribute that contains a text."""
    return F.coalesce(F.contains(F.element_at("attrs", name), F.lit(part)), F.lit(False))


def follow(nodes: DataFrame, steps: list[Step]) -> DataFrame:
    """The nodes that the steps lead to from the top of each page, each once: child and descendant steps go down from the
    nodes of the step before, a parent step goes up."""
    columns, at = nodes.columns, nodes.withColumn("_here", F.lit(None).cast("boolean"))  # null: above all nodes
    for k, step in enumerate(steps):
        first = k == 0
        if step.axis == "child":
            if first:
                found = at.withColumn("_here", F.col("parent_id") < 0)
            else:
                found = of_parent(at, {"_here": "_up"}).withColumn("_here", F.coalesce("_up", F.lit(False))).drop("_up")
        elif step.axis == "descendant":
            found = at.withColumn("_here", F.lit(True) if first else below(F.col("_here")))
        elif step.axis == "parent":
            kids = at.filter("_here").select(F.col("page_id").alias("_page"), F.col("parent_id").alias("_id")).distinct().withColumn("_up", F.lit(True))
            found = at.join(kids, (F.col("page_id") == F.col("_page")) & (F.col("node_id") == F.col("_id")), "left").withColumn("_here", F.coalesce("_up", F.lit(False))).drop("_page", "_id", "_up")
        else:
            raise ValueError(f"not an axis: {step.axis}")
        if step.tag != "*":
            found = found.withColumn("_here", F.col("_here") & (F.col("tag") == step.tag))
        for test in step.tests:
            if isinstance(test, int):
                way = F.col("node_id") if test > 0 else F.col("node_id").desc()
                place = F.sum(F.col("_here").cast("int")).over(Window.partitionBy("page_id", "parent_id").orderBy(way).rowsBetween(Window.unboundedPreceding, 0))
                found = found.withColumn("_here", F.col("_here") & (place == abs(test)))
            else:
                found = found.withColumn("_here", F.col("_here") & test)
        at = found
    return at.filter("_here").select(*columns)


# ---------------------------------------------------------------- tree distance

#: Where one node contains the other: the largest double.
CONTAINED = 1.7976931348623157e308


def chains(nodes: DataFrame) -> DataFrame:
    """page_id, node_id and chain: (id, tag, before, after) of its ancestors from the top, and of itself. Chains double in each round, so
    that a page of depth d takes log2(d) saved tables; those are small files of long rows, so no join may broadcast them."""
    scratch, step = Scratch(nodes.sparkSession, "chains"), 0
    me = F.struct(F.col("node_id").alias("id"), "tag", "before", "after")
    known = scratch.save(nodes.select("page_id", "node_id", F.col("parent_id").alias("up"), F.array(me).alias("chain")), "chains0")
    while not known.filter("up >= 0").isEmpty():  # up: the first ancestor that the chain lacks
        above = known.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_id"), F.col("up").alias("_up"), F.col("chain").alias("_chain"))
        longer = known.join(above.hint("merge"), (F.col("page_id") == F.col("_page")) & (F.col("up") == F.col("_id")), "left")
        step += 1
        chain = F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.concat("_chain", "chain"))
        known = scratch.save(longer.select("page_id", "node_id", F.coalesce("_up", F.lit(-1)).alias("up"), chain.alias("chain")), f"chains{step}")
        scratch.drop(f"chains{step - 1}")
    return known.drop("up")


def tree_distance(pairs: DataFrame, chain_table: DataFrame, depth_cost: float = 2, other_tag: float = 2, same_tag: float = 1, stride: float = 1) -> DataFrame:
    """`pairs` (page_id, a, b of nodes) with their distance: for each level from the common ancestor down, the cost of equal or of other
    tags, or of a level that only one of them has, and of each sibling that lies between the two branches. Below
    the first level, those are the siblings after the left branch and those before the right one. 0 for a node and itself."""
    chain = lambda k: chain_table.select("page_id", F.col("node_id").alias(k), F.col("chain").alias(f"_{k}"))
    both = pairs.join(chain("a").hint("merge"), ["page_id", "a"]).join(chain("b").hint("merge"), ["page_id", "b"])
    both = both.withColumn("_l", F.when(F.col("a") <= F.col("b"), F.col("_a")).otherwise(F.col("_b"))).withColumn("_r", F.when(F.col("a") <= F.col("b"), F.col("_b")).otherwise(F.col("_a")))
    shared = F.size(F.filter(F.arrays_zip("_l", "_r"), lambda z: F.coalesce(z["_l"]["id"] == z["_r"]["id"], F.lit(False))))
    both = both.withColumn("_c", shared)
    rest = lambda c: F.slice(F.col(c), F.col("_c") + 1, F.greatest(F.size(c) - F.col("_c"), F.lit(0)))
    both = both.withColumn("_l", rest("_l")).withColumn("_r", rest("_r"))

    def level(z: Column, i: Column) -> Column:
        l, r = z["_l"], z["_r"]  # noqa: E741
        strides = F.when(i == 0, r["before"] - l["before"] - 1).otherwise(F.coalesce(l["after"], F.lit(0)) + F.coalesce(r["before"], F.lit(0)))
        return F.when(l.isNull() | r.isNull(), F.lit(float(depth_cost))).otherwise(F.when(l["tag"] == r["tag"], F.lit(float(same_tag))).otherwise(F.lit(float(other_tag)))) + strides * float(stride)

    cost = F.aggregate(F.transform(F.arrays_zip("_l", "_r"), level), F.lit(float(same_tag)), lambda s, x: s + x)
    contained = (F.size("_l") == 0) | (F.size("_r") == 0)
    distance = F.when(F.col("a") == F.col("b"), 0.0).when(contained, CONTAINED).otherwise(cost)
    return both.withColumn("distance", distance).drop("_a", "_b", "_l", "_r", "_c")


# ---------------------------------------------------------------- segments by layout

#: Share of the window above which a block is split further.
LARGE = 0.3
#: Similarity of children up to which a node is split.
UNLIKE = 0.8


def counted_below(nodes: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """`nodes` with the number of marked nodes below each, by name: running sums at its own and at its last node's place."""
    sums = nodes
    for name, mark in marks.items():
        sums = sums.withColumn(f"_s_{name}", F.sum(mark.cast("int")).over(in_page()))
    ends = sums.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_id"), *(F.col(f"_s_{n}").alias(f"_e_{n}") for n in marks))
    out = sums.join(ends.hint("merge"), (F.col("page_id") == F.col("_page")) & (F.col("end_id") == F.col("_id")))
    for name in marks:
        out = out.withColumn(name, F.col(f"_e_{name}") - F.col(f"_s_{name}")).drop(f"_e_{name}", f"_s_{name}")
    return out.drop("_page", "_id")


def block_segments(nodes: DataFrame, window_area: float) -> DataFrame:
    """Segments of pages with layout: `nodes` with columns shown, and width and height of its rectangle.

    From the top down: ignored elements, single pixels and hidden nodes are left out with all below. A block with shown blocks below is a segment if it has
    a text of its own, else it is split; one without is a segment up to LARGE of the window, else it is split; with nothing but ignored
    children it gives none. Another element is split if a div is below it, or if it is larger than that; else it is a segment.
    """
    ignored, block = F.col("tag").isin(*sorted(IGNORED)), F.col("tag").isin(*sorted(SEGMENT_BLOCKS))
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0.0))
    kids = nodes.filter("parent_id >= 0").groupBy("page_id", "parent_id").agg(F.count("*").alias("_kids"), F.count_if(ignored).alias("_dull"))
    kids = kids.select(F.col("page_id").alias("_kp"), F.col("parent_id").alias("_ki"), "_kids", "_dull")
    counted = counted_below(nodes, {"_blocks": block & F.col("shown"), "_divs": F.col("tag") == "div"})
    known = counted.join(kids, (F.col("page_id") == F.col("_kp")) & (F.col("node_id") == F.col("_ki")), "left")
    out = ignored | ~F.col("shown") | ((F.col("width") == 1) & (F.col("height") == 1))
    small = F.when(area / window_area > LARGE, "split").otherwise("segment")
    of_block = F.when((F.col("_blocks") == 0) & (F.col("_kids") > 0) & (F.col("_kids") == F.col("_dull")), "none").when(F.col("_blocks") == 0, small).when(F.col("own_text"), "segment").otherwise("split")
    decided = known.withColumn("_way", F.when(out, "none").when(block, of_block).when(F.col("_divs") > 0, "split").otherwise(small))
    reached = decided.withColumn("_hidden", below(F.col("_way") != "split"))
    return reached.filter((F.col("_way") == "segment") & ~F.col("_hidden")).select(*nodes.columns)


def seams(left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, content: np.ndarray) -> tuple[float, float]:
    """Mean seam degree and mean cosine of content over the pairs of rectangles that face each other with none of the others between,
    to one decimal place; 0 without such a pair. Rectangles one above the other share a seam along their widths, else beside each other along their heights."""
    n, degrees, likes = len(left), [], []
    norms = np.linalg.norm(content, axis=1)

    def shared(a: np.ndarray, b: np.ndarray, i: int, j: int) -> float:
        """Square of the seam's length over the product of the two sides; a and b: where the sides begin and end."""
        if b[i] > b[j] and a[i] < a[j]:
            seam = b[j] - a[j]
        elif b[i] < b[j] and a[i] > a[j]:
            seam = b[i] - a[i]
        else:
            seam = abs(b[i] - a[j]) if b[i] < b[j] else abs(b[j] - a[i])
        sides = (b[i] - a[i]) * (b[j] - a[j])
        return seam * seam / sides if sides else 0.0

    def free(x1: float, x2: float, y1: float, y2: float, i: int, j: int) -> bool:
        meets = ~((x2 < left) | (x1 > right) | (y2 < top) | (y1 > bottom))
        meets[[i, j]] = False
        return not meets.any()

    for i in range(n):
        for j in range(i + 1, n):
            upper, lower = (i, j) if top[i] < top[j] else (j, i)
            first, second = (i, j) if left[i] < left[j] else (j, i)
            if right[i] > left[j] and left[i] < right[j] and free(min(left[i], left[j]), max(right[i], right[j]), bottom[upper], top[lower], i, j):
                degrees.append(shared(left, right, i, j))
            elif bottom[i] > top[j] and top[i] < bottom[j] and free(right[first], left[second], min(top[i], top[j]), max(bottom[i], bottom[j]), i, j):
                degrees.append(shared(top, bottom, i, j))
            else:
                continue
            likes.append(float(content[i] @ content[j] / (norms[i] * norms[j])) if norms[i] and norms[j] else 0.0)
    mean = lambda v: float(Decimal(sum(v) / len(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) if v else 0.0
    return mean(degrees), mean(likes)


def similarity_segments(nodes: DataFrame, content: DataFrame, measure: Callable = seams) -> DataFrame:
    """Segments of pages with layout by the likeness of children: `nodes` with shown, left, top, width, height; `content`: page_id,
    node_id, content (array).

    From the top down: a block with shown children that are or hold blocks, and no text of its own (a body may have one), is split if it has
    a single such child, or if the seams or contents of its children are alike to UNLIKE at most. Every other shown node is a segment. A node's
    children are compared in one row, of one node's children, and only where the split depends on them; two numbers of it come out."""
    ignored, block = F.col("tag").isin(*sorted(IGNORED)), F.col("tag").isin(*sorted(SEGMENT_BLOCKS))
    seen = F.col("shown") & ~((F.col("width") == 1) & (F.col("height") == 1))
    marked = counted_below(nodes, {"_inner": block}).withColumn("_seen", seen).withColumn("_block", block & ~ignored)
    holds = F.col("_block") | (F.col("_inner") > 0)
    kids = marked.filter("parent_id >= 0 AND _seen").groupBy(F.col("page_id").alias("_kp"), F.col("parent_id").alias("_ki")).agg(F.count("*").alias("_kids"), F.count_if(holds).alias("_deep"))
    known = marked.join(kids.hint("merge"), (F.col("page_id") == F.col("_kp")) & (F.col("node_id") == F.col("_ki")), "left").drop("_kp", "_ki")
    whole = ~F.col("_block") | (F.coalesce("_deep", F.lit(0)) == 0) | (F.col("own_text") & (F.col("tag") != "body"))
    known = known.withColumn("_whole", whole)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c in batch.column(2).to_pylist():
                left, top, width, height = (np.array([k[n] for k in c], np.float64) for n in ("left", "top", "width", "height"))
                found.append(measure(left, top, left + width, top + height, np.array([k["content"] for k in c], np.float64).reshape(len(c), -1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], ["_kp", "_ki", "_degree", "_like"])

    # only the children of nodes that their likeness decides on
    asked = known.filter(~F.col("_whole") & ~ignored & F.col("_seen") & (F.col("_kids") > 1)).select(F.col("page_id").alias("_kp"), F.col("node_id").alias("_ki"))
    own = marked.filter("parent_id >= 0 AND _seen").select("page_id", "parent_id", "node_id", *(F.col(c).cast("double").alias(c) for c in ("left", "top", "width", "height")))
    some = own.join(asked.hint("merge"), (F.col("page_id") == F.col("_kp")) & (F.col("parent_id") == F.col("_ki"))).join(content.hint("merge"), ["page_id", "node_id"])
    lists = some.groupBy("_kp", "_ki").agg(F.array_sort(F.collect_list(F.struct("node_id", "left", "top", "width", "height", "content"))).alias("c"))
    bound_batches(nodes.sparkSession, 4 << 20)
    sums = lists.select("_kp", "_ki", "c").mapInArrow(of, "_kp long, _ki long, _degree double, _like double")
    known = known.join(sums.hint("merge"), (F.col("page_id") == F.col("_kp")) & (F.col("node_id") == F.col("_ki")), "left")
    unlike = (F.col("_kids") == 1) | (F.col("_degree") <= UNLIKE) | (F.col("_like") <= UNLIKE)
    decided = known.withColumn("_way", F.when(ignored | ~F.col("_seen"), "none").when(F.col("_whole"), "segment").when(unlike, "split").otherwise("segment"))
    reached = decided.withColumn("_hidden", below(F.col("_way") != "split"))
    return reached.filter((F.col("_way") == "segment") & ~F.col("_hidden")).select(*nodes.columns)
