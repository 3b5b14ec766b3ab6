"""Vector code compression: product quantisation with integer codebooks.

Vectors are cut into PARTS equal consecutive parts. Each part position has a codebook, which starts as that
part of the rows of smallest vec_id. A round assigns every part to the nearest entry and replaces each entry
by the componentwise floor of the mean of its parts; an entry without parts stays. Codebooks are bounded
(PARTS x ENTRIES parts) and broadcast; Arrow batches compute all distances by norm expansion,
|x|^2 - 2 x.c + |c|^2, as exact int64 matrix products, and take the first argmin. A task adds up its parts by entry before
anything moves, so a round shuffles at most PARTS x ENTRIES x width sums a task.

Defined results: rows with a null vector, or null or non-finite components, are dropped; a vector shorter
than the longest is padded with zeros, and the longest to a multiple of PARTS; with fewer rows than ENTRIES
the codebooks are as short; rows that repeat a vec_id count each, ordered by their vectors, a null vec_id
comes last; null labels are one group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import worker
from .vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Most labels whose sums are broadcast; beyond it they are joined in SALTS parts.
BROADCAST_LABELS, SALTS = 50_000, 16


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `parts`, the first entry of `book` at the least squared distance, and that distance."""
    d = (parts * parts).sum(1)[:, None] - 2 * (parts @ book.T) + (book * book).sum(1)
    k = d.argmin(1)
    return k, d[np.arange(len(d)), k]


def _sums(books: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("vector_codes")
        b = books.value
        parts, entries, width = b.shape
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width).reshape(batch.num_rows, parts, width)
            for p in range(parts):
                k, _ = nearest(x[:, p], b[p])
                counts[p] += np.bincount(k, minlength=entries)
                # a batch's sums stay below 2^53, so the float weights are exact
                for j in range(width):
                    totals[p, :, j] += np.bincount(k, weights=x[:, p, j], minlength=entries).astype(np.int64)
        at = np.argwhere(np.broadcast_to((counts > 0)[:, :, None], totals.shape))
        columns = [*at.T, totals[tuple(at.T)], counts[tuple(at.T[:2])]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    return run


def _coded(books: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("vector_codes")
        b = books.value
        parts, _, width = b.shape
        for batch in batches:
            x = matrix(batch.column(2), parts * width).reshape(batch.num_rows, parts, width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                k, d = nearest(x[:, p], b[p])
                codes[:, p] = k
                error += d
            text = [bytes(c).hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def train(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of a saved table of integer vectors; no entries if it is empty."""
    longest = vectors.agg(F.max(F.length("vec"))).first()[0] or 0
    width = -(-longest // 4 // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    books = matrix(pa.array([bytes(r.vec) for r in first], pa.binary()), parts * width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if first and width else 0):
        sent = spark.sparkContext.broadcast(books)
        sums = vectors.select("vec").mapInArrow(_sums(sent), "part long, entry long, place long, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toLocalIterator():
            books[r.part, r.entry, r.place] = r.total // r.n
        sent.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(scratch: Scratch, coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """`coded` (saved) with label_error, the error summed over equal labels. The sums are made before they move;
    they are broadcast after a check of their number, else a label's rows meet them in salted parts."""
    sums = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "sums")
    if sums.count() <= broadcast_labels:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    spread = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))).drop("of_label", "salt", "of_salt")


def encode(spark: SparkSession, rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of each row that has a vector (a saved table), and the codebooks."""
    scratch = Scratch(spark, "codes")
    vectors = scratch.save(integer_vectors(rows), "vectors")
    books = train(spark, vectors, parts, entries, rounds)
    if not books.shape[1]:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long"), books
    coded = vectors.select("vec_id", "label", "vec").mapInArrow(_coded(spark.sparkContext.broadcast(books)), "vec_id long, label long, code string, error long")
    return scratch.save(coded, "coded"), books


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for, padding included."""
    at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), books.shape[0])
    return books[np.arange(books.shape[0]), at].reshape(len(codes), -1)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(spark, table(spark, sf_dir, "embeddings"))
    out = with_label_error(Scratch(spark, "codes-sums"), coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    return f"""(SELECT vec_id, label, parts.p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d, any_value(x) AS x FROM (
  SELECT parts.*, b.e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN {books} AS b ON parts.p = b.p) AS parts GROUP BY vec_id, label, parts.p)"""


def _replaced(books: str) -> str:
    return f"""(SELECT old.p, old.e, coalesce(new.c, old.c) AS c FROM {books} AS old LEFT JOIN (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT p, e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM {_assigned(books)} AS a, range(1, {"(SELECT w FROM size)"} + 1) AS t(j) GROUP BY p, e, j) AS s GROUP BY p, e) AS new ON old.p = new.p AND old.e = new.e)"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS MATERIALIZED (SELECT max(len(v)) // {PARTS} AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, size, range({PARTS}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) AS s WHERE e < {ENTRIES}),
b1 AS MATERIALIZED {_replaced("b0")},
b2 AS MATERIALIZED {_replaced("b1")},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {_assigned("b2")} AS a GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded
"""
