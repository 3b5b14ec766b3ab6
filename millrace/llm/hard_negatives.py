"""Hard-negative mining by a vantage-point tree over norm-augmented vectors.

A row x gets one more place, sqrt(M - |x|^2), where M is the largest squared norm; an anchor a gets a zero. Then
|a - x|^2 = |a|^2 + M - 2 a.x: the larger the inner product, the nearer the row, and a window of scores is an
annulus around the anchor.

Index: a vantage tree over a bounded sample routes every row to a cell; a cell is cut by hash into parts of
CELL_ROWS rows, however many rows are alike, and each part becomes one index row: a vantage-point tree of its
own, split at median distances, with the least and largest distance of each leaf to the vantage points above
it. Search: anchors come in rounds of at most some ROUND; a round's anchors are broadcast and all index rows are read. In a
part, an anchor's leaves are visited nearest first. The triangle inequality rules out leaves outside the
annulus, and those beyond the k-th best row that the task has found so far. Scores are exact integer
products. A task emits k rows for each anchor and window; these alone are shuffled and merged.

The same search runs twice: for the positives (same label, no window, k = 5), then for each positive's window
(other labels, k = 3).

Vectors without structure leave the tree little to rule out; the result stays exact, at the cost of a full
comparison of the anchors with all rows.

Defined results: rows with a null label, a null vector or null or non-finite components take no part; rows
that repeat a vec_id count each; a null vec_id is no anchor and comes last among equal scores (ids are below 2^63 - 1);
vectors of different lengths are padded with zeros; an anchor without positives gives no rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import worker
from .vectors import integer_vectors, matrix

POSITIVES, NEGATIVES = 5, 3
CELL_ROWS, LEAF_ROWS = 1024, 64
#: Rows that place the routing tree, its most levels, and the files of an index at most.
SAMPLE, LEVELS, FILES = 2048, 10, 8192
#: Anchors that are broadcast at once, about.
ROUND = 16384
NO_ID, LOWEST, HIGHEST = (1 << 63) - 1, -(1 << 62), 1 << 62
INDEX = "rows binary, ids binary, labels binary, vecs binary, vantages binary, spans binary"
FOUND = "anchor long, place int, score long, id long"


@dataclass
class Space:
    """Width of the vectors and largest squared norm of a table."""

    width: int
    top: int

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (math.sqrt(self.top) + 1)

    @property
    def exact_in_double(self) -> bool:
        return self.top < 1 << 52

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of integer rows: |a.b| is at most the largest squared norm."""
        if self.exact_in_double:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T

    def between(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distances of augmented rows x to one augmented row v."""
        n, m = (x * x).sum(1).astype(np.float64), float((v * v).sum())
        lift = np.sqrt(np.maximum(0, self.top - n)) - math.sqrt(max(0, self.top - m))
        return np.sqrt(np.maximum(0, n + m - 2.0 * self.products(x, v[None])[:, 0]) + lift * lift)


def vantage(space: Space, x: np.ndarray) -> int:
    """Of eight rows, the one whose distances to some others vary most."""
    step = max(1, len(x) // 64)
    return max(range(0, len(x), max(1, -(-len(x) // 8))), key=lambda i: space.between(x[::step], x[i]).std())


def grow(space: Space, x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A complete vantage-point tree of `levels`: the rows' order by leaf, the ends of the leaves, and the vantage
    row of each node (breadth first)."""
    sets, vantages = [np.arange(len(x))], []
    for _ in range(levels):
        halves = []
        for rows in sets:
            v = rows[vantage(space, x[rows])]
            vantages.append(v)
            order = rows[np.argsort(space.between(x[rows], x[v]), kind="stable")]
            halves += [order[: (len(rows) + 1) // 2], order[(len(rows) + 1) // 2 :]]
        sets = halves
    return np.concatenate(sets), np.cumsum([len(s) for s in sets]), np.array(vantages, np.int64)


def depth(rows: int, leaf: int, most: int = 30) -> int:
    return max(0, min(most, int(math.log2(max(1, rows // leaf)))))


def path(leaf: int, levels: int) -> list[int]:
    """Nodes (breadth first) above a leaf."""
    return [(1 << k) - 1 + (leaf >> (levels - k)) for k in range(levels)]


class Router:
    """The tree over the sample: vantage points and median distances, level by level."""

    def __init__(self, space: Space, x: np.ndarray, levels: int):
        self.space, self.levels = space, min(levels, depth(len(x), 2))
        order, ends, vantages = grow(space, x, self.levels)
        self.points, self.radius = x[vantages], np.zeros(len(vantages))
        starts = np.concatenate([[0], ends])
        for k in range(self.levels):
            for i in range(1 << k):
                node, span = (1 << k) - 1 + i, 1 << (self.levels - k)
                inner = order[starts[i * span] : starts[i * span + span // 2]]
                self.radius[node] = space.between(x[inner], self.points[node]).max()

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for k in range(self.levels):
            for i in np.unique(at):
                rows, node = np.flatnonzero(at == i), (1 << k) - 1 + i
                at[rows] = 2 * i + (self.space.between(x[rows], self.points[node]) > self.radius[node])
            # cells of a level are numbered from zero
        return at


def _routed(router: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("hard_negatives")
        r = router.value
        for batch in batches:
            cells = r.cells(matrix(batch.column(batch.schema.get_field_index("vec")), r.space.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    return run


def _indexed(space: Space):
    def run(t: pa.Table) -> pa.Table:
        """The index row of one part of a cell."""
        worker.begin("hard_negatives")
        t = t.combine_chunks()
        x = matrix(t.column("vec").combine_chunks(), space.width)
        levels = depth(len(x), LEAF_ROWS)
        order, ends, vantages = grow(space, x, levels)
        spans = np.zeros((len(ends), levels, 2))
        starts = np.concatenate([[0], ends])
        for leaf in range(len(ends)):
            inner = x[order[starts[leaf] : starts[leaf + 1]]]
            for k, node in enumerate(path(leaf, levels)):
                d = space.between(inner, x[vantages[node]])
                spans[leaf, k] = d.min(), d.max()
        blobs = [t.column("row").to_numpy()[order], t.column("vec_id").fill_null(NO_ID).to_numpy()[order], t.column("label").to_numpy()[order], x[order].astype("<i4"), np.argsort(order)[vantages].astype(np.int64), spans]
        return pa.table([pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs], names=[f.split()[0] for f in INDEX.split(", ")])

    return run


def build(scratch: Scratch, vectors: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Space]:
    """The index of a saved table of integer vectors (labels non-null), one row for each part of a cell."""
    spark = scratch.spark
    rows, top, longest = vectors.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0)), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    space = Space(longest // 4, top)
    sample = vectors.orderBy(F.xxhash64("vec"), "row").limit(SAMPLE).select("vec").collect()
    router = Router(space, matrix(pa.array([bytes(r.vec) for r in sample], pa.binary()), space.width), depth(rows, cell_rows, LEVELS)) if sample else None
    if router is None:
        return spark.createDataFrame([], INDEX), space
    routed = scratch.save(vectors.mapInArrow(_routed(spark.sparkContext.broadcast(router)), "row long, vec_id long, label long, norm long, vec binary, cell long"), "routed")
    # at most 2^LEVELS cells; a cell of many rows is cut by hash
    sizes = {r.cell: -(-r.n // cell_rows) for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    dealt = routed.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("cell")]))
    dealt = dealt.repartition(min(FILES, sum(sizes.values())), "cell", "part")
    index = scratch.save(dealt.groupBy("cell", "part").applyInArrow(_indexed(space), INDEX), "index")
    scratch.drop("routed")
    return index, space


class Best:
    """The k best rows of each query (anchor and window): score descending, id ascending, row ascending."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LOWEST, np.int64)
        self.id = np.full((queries, k), NO_ID, np.int64)
        self.row = np.full((queries, k), NO_ID, np.int64)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.id[touched].ravel(), ids])
        r = np.concatenate([self.row[touched].ravel(), rows])
        order = np.lexsort((r, i, -s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        at, order = (q[kept], rank[kept]), order[kept]
        self.score[at], self.id[at], self.row[at] = s[order], i[order], r[order]


class Part:
    """One index row, opened."""

    def __init__(self, space: Space, blobs: dict[str, bytes]):
        read = lambda name, kind: np.frombuffer(blobs[name], kind)
        self.rows, self.ids, self.labels = (read(n, np.int64) for n in ("rows", "ids", "labels"))
        self.x = read("vecs", "<i4").reshape(len(self.rows), space.width)
        self.levels = depth(len(self.rows), LEAF_ROWS)
        self.nodes = read("vantages", np.int64)
        self.spans = read("spans", np.float64).reshape(1 << self.levels, self.levels, 2)
        self.paths = np.array([path(leaf, self.levels) for leaf in range(1 << self.levels)], np.int64).reshape(1 << self.levels, self.levels)
        sizes = [len(self.rows)]
        for _ in range(self.levels):
            sizes = [n for s in sizes for n in ((s + 1) // 2, s // 2)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])


class Search:
    """A round's anchors and what a task has found for them. Windows are [low, high] of scores, one row of `places`
    for each anchor; an empty window is low > high."""

    def __init__(self, space: Space, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.space, self.rows, self.labels, self.x, self.low, self.high, self.same = space, rows, labels, x, low, high, same
        self.base = (x * x).sum(1).astype(np.float64) + space.top
        self.best = Best(low.size, k)
        self.lookups = 0

    def radius(self, scores: np.ndarray) -> np.ndarray:
        """Distance at which rows have these scores (a row for each anchor)."""
        return np.sqrt(np.maximum(0, self.base[:, None] - 2.0 * scores))

    def floor(self) -> np.ndarray:
        """The least score that still counts: the window's, or that of the k-th best row found."""
        return np.maximum(self.low, self.best.least().reshape(self.low.shape))

    def visit(self, part: Part) -> None:
        """Nearest first, each anchor its own order of leaves; one step takes every anchor's next leaf."""
        leaves = len(part.paths)
        near, far = np.zeros((len(self.x), leaves)), np.full((len(self.x), leaves), np.inf)
        if part.levels:
            to = np.sqrt(np.maximum(0, self.base[:, None] - 2.0 * self.space.products(self.x, part.x[part.nodes])))
            for k in range(part.levels):
                d = to[:, part.paths[:, k]]
                near = np.maximum(near, np.maximum(d - part.spans[:, k, 1], part.spans[:, k, 0] - d))
                far = np.minimum(far, d + part.spans[:, k, 1])
        order = np.argsort(near, axis=1, kind="stable")
        inner, everyone = self.radius(self.high) - self.space.slack, np.arange(len(self.x))
        for step in range(leaves):
            at = order[:, step]
            floor = self.floor()
            # the anchor's next leaf must meet the annulus of one of its windows
            wanted = ((near[everyone, at, None] <= self.radius(floor) + self.space.slack) & (far[everyone, at, None] >= inner) & (floor <= self.high)).any(1)
            hits = [self.compare(part, leaf, np.flatnonzero(wanted & (at == leaf)), floor) for leaf in np.unique(at[wanted])]
            if hits:
                anchor, row, score = (np.concatenate(c) for c in zip(*hits))
                for w in range(self.low.shape[1]):
                    fits = (score >= floor[anchor, w]) & (score <= self.high[anchor, w])
                    self.best.add(anchor[fits] * self.low.shape[1] + w, score[fits], part.ids[row[fits]], part.rows[row[fits]])

    def compare(self, part: Part, leaf: int, anchors: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row of the part, score) of the pairs of a leaf that may enter a window."""
        a, b = part.starts[leaf], part.starts[leaf + 1]
        self.lookups += len(anchors) * int(b - a)
        scores = self.space.products(self.x[anchors], part.x[a:b])
        i, j = np.nonzero((scores >= floor[anchors].min(1)[:, None]) & ((self.labels[anchors][:, None] == part.labels[a:b]) == self.same) & (self.rows[anchors][:, None] != part.rows[a:b]))
        return anchors[i], j + a, scores[i, j]


def _searched(sent: Broadcast, k: int, same: bool, space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("hard_negatives")
        search = Search(space, *sent.value, same, k)
        for batch in batches:
            for blobs in batch.to_pylist():
                search.visit(Part(space, blobs))
        best, places = search.best, search.low.shape[1]
        query, _ = hit = np.nonzero(best.row != NO_ID)
        columns = [search.rows[query // places], (query % places).astype(np.int32), best.score[hit], best.id[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "place", "score", "id"])

    return run


def find(scratch: Scratch, index: DataFrame, space: Space, anchors: DataFrame, same: bool, k: int, name: str, round_: int = ROUND) -> DataFrame:
    """anchor (row), place (of its window), score, id and rank of the k best rows of each anchor and window.
    `anchors`: row, label, vec and windows (array of structs low, high), saved."""
    spark = scratch.spark
    n, places = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("windows")), F.lit(1))).first()
    rounds, found = max(1, -(-n // round_)), []
    for r in range(rounds if n else 0):
        t = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).toArrow().combine_chunks()
        if not t.num_rows:
            continue
        low, high = np.full((t.num_rows, places), HIGHEST, np.int64), np.full((t.num_rows, places), LOWEST, np.int64)
        for i, windows in enumerate(t.column("windows").to_pylist()):
            for w, window in enumerate(windows):
                low[i, w], high[i, w] = window["low"], window["high"]
        sent = spark.sparkContext.broadcast((t.column("row").to_numpy(), t.column("label").to_numpy(), matrix(t.column("vec").combine_chunks(), space.width), low, high))
        found.append(scratch.save(index.mapInArrow(_searched(sent, k, same, space), FOUND), f"{name}{r}"))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    # a task gives at most k rows of a window
    ranked = all_.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")))
    return scratch.save(ranked.filter(F.col("rank") <= k), name)


def mine(
    spark: SparkSession, rows: DataFrame, anchor: Column, label: Column, low: Column, high: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, round_: int = ROUND, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Hard negatives of the rows of `rows` (vec_id, embedding, label) for which `anchor` holds, under the labels
    `label`, with scores from `low` to `high` (expressions of positive_score): anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    scratch = Scratch(spark, "negatives")
    vectors = scratch.save(integer_vectors(rows).withColumn("label", label).filter("label IS NOT NULL"), "vectors")
    index, space = build(scratch, vectors, cell_rows)
    any_score = F.array(F.struct(F.lit(LOWEST + 1).alias("low"), F.lit(HIGHEST).alias("high")))
    anchors = scratch.save(vectors.filter(anchor).select("row", "vec_id", "label", "vec", any_score.alias("windows")), "anchors")
    first = find(scratch, index, space, anchors, True, positives, "positives", round_).withColumnRenamed("score", "positive_score")
    given = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), low.alias("low"), high.alias("high")))).alias("windows"))
    wanted = scratch.save(anchors.drop("windows").join(given, F.col("row") == F.col("anchor")).drop("anchor"), "wanted")
    second = find(scratch, index, space, wanted.select("row", "label", "vec", "windows"), False, negatives, "negatives", round_)
    named = first.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive"), "positive_score")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        second.join(named, ["anchor", "place"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("positive_score")
    return mine(
        spark,
        table(spark, sf_dir, "embeddings"),
        F.col("vec_id") % 50 == 0,
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")),
        F.ceil(score * 50 / F.lit(100).cast("decimal(3,0)")).cast("long"),
        F.floor(score * 95 / F.lit(100).cast("decimal(3,0)")).cast("long"),
    )


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept AS a JOIN kept AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= {NEGATIVES}
"""
