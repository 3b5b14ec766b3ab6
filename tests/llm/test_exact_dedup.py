import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import exact_dedup as X

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("recipe", T.StringType()), T.StructField("id", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def long_text(seed, n):
    rng = np.random.default_rng(seed)
    return "".join(map(chr, rng.integers(97, 123, n))) + "é"


ROWS = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "A"), (6, long_text(1, 200_000)), (7, long_text(1, 200_000)), (8, long_text(1, 199_999)), (9, "b" * 70_000), (9, "b" * 70_000), (10, "b" * 70_001), (11, "a ")]


@pytest.mark.parametrize("weak", [False, True])
def test_matches_brute_force(spark, weak):
    rows = ROWS
    if weak:  # a hash that puts many chunks together: the bytes must decide
        got = X.exact_groups(spark, frame(spark, rows), chunk_id=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    else:
        got = X.exact_groups(spark, frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table(spark):
    assert X.exact_groups(spark, frame(spark, [])).count() == 0


def test_dedup_keeps_columns_and_one_row(spark):
    out = X.exact_dedup(spark, frame(spark, [(1, "a"), (2, "a"), (3, None), (4, "")]))
    assert out.columns == ["doc_id", "text", "recipe", "id"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 4]


def test_dedup_decides_by_row(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (7, "C"), (7, "C"), (None, "D"), (None, "D"), (None, "A")]
    out = X.exact_dedup(spark, frame(spark, rows))
    assert sorted(((r.doc_id or 0), r.text) for r in out.collect()) == [(0, "D"), (5, "B"), (7, "C"), (9, "A")]
    assert out.columns == ["doc_id", "text", "recipe", "id"]


def test_rows_without_id(spark):
    rows = [(None, "a"), (1, "a"), (None, "alone")]
    got = {(r.doc_id, r.keep_id, r.kept) for r in X.exact_groups(spark, frame(spark, rows)).collect()}
    assert got == {(None, 1, False), (1, 1, True), (None, None, True)}
    assert "alone" in {r.text for r in X.exact_dedup(spark, frame(spark, rows)).collect()}


def test_cuts_depend_on_the_text_alone():
    a = long_text(5, 30_000).encode()
    alone = np.frombuffer(a, np.uint8)
    among = np.frombuffer(b"zz" * 999 + a + b"q" * 5000, np.uint8)
    one = X.cut_points(alone, np.array([0]), np.array([len(a)]))[0]
    two = X.cut_points(among, np.array([1998]), np.array([1998 + len(a)]))[0]
    assert [x + 1998 for x in one] == two
    assert max(np.diff([0, *one])) <= X.MAX_CHUNK and one[-1] == len(a)
