"""Sparse matrices: a stored row layout, and a truncated SVD that never makes the matrix or its Gram matrix dense.

Rows are (id, indices, values). The SVD is a randomised range finder: a block of k + 10 columns is multiplied by A
and its transpose a few times, each time in one pass over the rows, and orthonormalised; a tall-skinny QR of A times the last block gives
the singular values. A task adds up its rows' products by column before they move, column blocks are
summed by block, and the driver holds the block: columns x (k + 10) numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

EXTRA, PASSES = 10, 7
#: Columns of a block, parts in which triangles meet, and non-zero numbers that a task multiplies at once.
BLOCK, PARTS, CHUNK = 128, 16, 20_000
#: Blocks of an Arrow batch.
AT_ONCE = 128
LAYOUT = "id long, indices array<int>, values array<double>"


def layout(df: DataFrame, id_col: str, features: str) -> DataFrame:
    """The rows of a vector column (sparse or dense) in the stored layout, zeros left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, kinds = (pc.struct_field(batch.column(1), f) for f in ("indices", "values", "type"))
            if not batch.column(1).null_count and not pc.any(pc.not_equal(kinds, 0)).as_py() and not pc.any(pc.equal(values.flatten(), 0.0)).as_py():
                yield pa.RecordBatch.from_arrays([batch.column(0), at, values], ["id", "indices", "values"])
                continue
            at, values = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v["values"] if v else [], np.float64)
                i = np.array(v["indices"], np.int32) if v and v["type"] == 0 else np.arange(len(x), dtype=np.int32)
                at.append(i[x != 0])
                values.append(x[x != 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["id", "indices", "values"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features)).mapInArrow(run, LAYOUT)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, column, value, number of rows) of a batch of indices and values, some CHUNK numbers at once."""
    sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    column, value = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, side="right")))
        s = slice(ends[first - 1] if first else 0, ends[last - 1])
        yield np.repeat(np.arange(last - first), sizes[first:last]), column[s], value[s], last - first
        first = last


def times(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """A chunk's rows times w."""
    out = np.zeros((n, w.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(w[column] * value[:, None], starts)
    return out


def gram_times(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """A'(A w) in one pass over the rows. A task has sums of the size of w, and there are as many tasks as cores, so
    that what is shuffled doesn't grow with the rows."""
    spark, width = rows.sparkSession, w.shape[1]
    sent = spark.sparkContext.broadcast(w)
    blocks = -(-len(w) // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held, met = sent.value, np.zeros((blocks * BLOCK, width)), np.zeros(blocks, bool)
        for batch in batches:
            for row, column, value, n in chunks(batch):
                if not len(row):
                    continue
                y = times(row, column, value, n, w)
                order = np.argsort(column, kind="stable")
                sorted_ = column[order]
                starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
                at = sorted_[starts]
                held[at] += np.add.reduceat(y[row[order]] * value[order][:, None], starts)
                met[at // BLOCK] = True
        found = np.flatnonzero(met)
        for first in range(0, len(found), AT_ONCE):
            yield packed({int(k): held[k * BLOCK : (k + 1) * BLOCK] for k in found[first : first + AT_ONCE]})

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["block", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has its blocks' sums alone; what is added streams by."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(sums, np.float64).reshape(BLOCK, width)
                held[block] = held[block] + new if block in held else new
        yield packed(held)

    kind = "block long, sums binary"
    parts = rows.select("indices", "values").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, kind)
    out = np.zeros((blocks * BLOCK, width))
    # the driver has these numbers in `out` all the same: one job, not one for each part
    for r in parts.repartition(PARTS, "block").mapInArrow(summed, kind).toArrow().to_batches():
        for block, sums in zip(r.column(0).to_pylist(), r.column(1)):
            out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums.as_buffer(), np.float64).reshape(BLOCK, width)
    sent.unpersist()
    return out[: len(w)]


def triangle(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """R of the QR factors of A w: each task's R, then the Rs of PARTS parts, then one: (k + 10)^2 numbers each."""
    width = w.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def shrink(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((width, width))
        for batch in batches:
            for row, column, value, n in chunks(batch):
                r = np.linalg.qr(np.concatenate([r, times(row, column, value, n, sent.value)]), mode="r")
        yield shrink(r)

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((width, width))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(raw, np.float64).reshape(-1, width)]), mode="r")
        yield shrink(r)

    some = rows.select("indices", "values").mapInArrow(run, "r binary").repartition(PARTS).mapInArrow(stack, "r binary").collect()
    sent.unpersist()
    return np.linalg.qr(np.concatenate([np.frombuffer(x.r, np.float64).reshape(-1, width) for x in some]), mode="r")


def svd(rows: DataFrame, columns: int, k: int, passes: int = PASSES, extra: int = EXTRA, seed: int = 0) -> tuple[list[float], np.ndarray]:
    """The k largest singular values of rows in the stored layout with `columns` columns, and their components
    (k x columns; the largest entry of each is positive). A matrix of lower rank has zeros at the end."""
    saved = Scratch(rows.sparkSession, "svd").save(rows.select("indices", "values"), "rows")
    width = min(columns, k + extra)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, width)))[0]
    for _ in range(passes):
        w = np.linalg.qr(gram_times(saved, w))[0]
    _, values, turn = np.linalg.svd(triangle(saved, w))
    components = (w @ turn.T).T[:k]
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])
    return values[:k].tolist(), components * signs[:, None]


def explained(rows: DataFrame, columns: int, components: np.ndarray) -> list[float]:
    """Share of the rows' variance that the projection on each component explains."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(components.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square, all_square = 0, np.zeros(len(components)), np.zeros(len(components)), 0.0
        for batch in batches:
            for row, column, value, m in chunks(batch):
                y = times(row, column, value, m, sent.value)
                n, total, square, all_square = n + m, total + y.sum(0), square + (y * y).sum(0), all_square + float((value * value).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.tolist()]), pa.array([all_square])], ["n", "total", "square", "all_square"])

    parts = rows.select("indices", "values").mapInArrow(run, "n long, total array<double>, square array<double>, all_square double")
    add = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(len(components))))
    r = parts.agg(F.sum("n").alias("n"), add("total").alias("total"), add("square").alias("square"), F.sum("all_square").alias("all_square")).first()
    # the trace of the covariance needs the columns' means
    means = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).groupBy("e.indices").agg(F.sum("e.values").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    n = max(r.n, 1)
    trace = r.all_square / n - means / n**2
    return [(q / n - (t / n) ** 2) / max(trace, 1e-300) for q, t in zip(r.square, r.total)]
