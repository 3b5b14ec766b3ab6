"""Vectors as rows of integers, for the operators on embeddings.

Each component x becomes floor(256 * x), x as double. Rows whose vector is null, or holds null or non-finite
components, are left out. A component beyond LIMIT counts as LIMIT, so that sums of squares stay exact in 64
bits; a vector shorter than the longest counts as padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker

LIMIT = 1 << 24
SCHEMA = "row long, vec_id long, label long, norm long, vec binary"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.begin("vectors")
    for batch in batches:
        lists = batch.column(3)
        if not len(lists):
            continue
        values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = pc.is_valid(lists).to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(256.0 * np.where(np.isfinite(values), values, 0.0)), -LIMIT, LIMIT).astype("<i4")
        squares = np.concatenate([[0], np.cumsum(whole.astype(np.int64) ** 2)])
        vectors = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends * 4), pa.py_buffer(whole)])
        norms = pa.array(squares[ends[1:]] - squares[ends[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), norms, vectors.cast(pa.binary())], ["row", "vec_id", "label", "norm", "vec"]).filter(pa.array(keep))


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row (a number for each row), vec_id, label, norm (sum of squares) and vec (32-bit integers) of the rows
    that have a vector."""
    picked = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    return picked.mapInArrow(_integers, SCHEMA)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of `vec` as int64 rows of `width` places, zeros where a vector is shorter."""
    out = np.zeros((len(column), width), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        row = np.frombuffer(raw, "<i4")
        out[i, : len(row)] = row
    return out
