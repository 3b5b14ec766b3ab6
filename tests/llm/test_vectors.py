"""Vector codes and hard negatives against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import hard_negatives as H
from millrace.llm import vector_codes as C

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("row", T.StringType()), T.StructField("Cell", T.StringType()), T.StructField("vec", T.StringType()),
])


def table_of(spark, tmp_path, rows):
    spark.createDataFrame([(a, b, c, "x", "y", "z") for a, b, c in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def odd_rows(n, width=32, seed=3):
    """Vectors with ties, repeats, nulls and extremes."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (n, width)).astype(np.float32)
    base[n // 2 :] = base[n // 2 :] * 0.05 + base[0]  # a third of all rows and more lie together
    rows = [(i, [float(x) for x in base[i]], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[7][1], 2) for i in range(40)]  # equal vectors
    rows += [(n + 50, None, 1), (n + 51, [None] + rows[0][1][1:], 1), (n + 52, [math.nan] + rows[0][1][1:], 1), (n + 53, [math.inf] + rows[0][1][1:], 1), (n + 54, rows[3][1], None)]
    return rows


def whole(vector):
    return None if vector is None or any(x is None or not math.isfinite(x) for x in vector) else [math.floor(256 * x) for x in vector]


def brute_codes(rows, parts=16, entries=64):
    kept = sorted(((i, whole(v), c) for i, v, c in rows if whole(v) is not None), key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    best = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(p, c[p])[1], []).append(c[p])
            for k, xs in members.items():
                books[p][k] = [sum(x[j] for x in xs) // len(xs) for j in range(width)]
    coded = [(i, [best(p, c[p]) for p in range(parts)], label) for (i, _, label), c in zip(kept, cut)]
    sums = {}
    for _, b, label in coded:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in b)
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), sums[label], sha) for i, b, label in coded)


@pytest.mark.parametrize("n", [30, 150])
def test_codes_match_brute_force(spark, tmp_path, n):
    rows = odd_rows(n)
    got = C.op13_vector_codes(spark, table_of(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect())) == brute_codes(rows)


def test_code_edges(spark, tmp_path):
    assert C.op13_vector_codes(spark, table_of(spark, tmp_path / "a", [])).count() == 0
    rows = [(5, [1.0, 2.0], 1), (5, [0.5], None), (None, [], 1), (6, [1e30] * 20, 1), (6, [-1e30] * 20, 1), (7, [0.1] * 20, None)]
    got = C.op13_vector_codes(spark, table_of(spark, tmp_path / "b", rows)).collect()
    assert len(got) == 6 and all(len(r.code) == 32 and r.error == 0 for r in got)
    only = C.op13_vector_codes(spark, table_of(spark, tmp_path / "c", [(1, [], 1), (2, None, 1)])).collect()
    assert [(r.vec_id, r.code, r.error) for r in only] == [(1, "00" * 16, 0)]


def test_many_labels_join_in_parts(spark, tmp_path):
    rows = odd_rows(60)
    from millrace.session import Scratch, table

    coded, books = C.encode(spark, table(spark, table_of(spark, tmp_path, rows), "embeddings"))
    a, b = (sorted(map(repr, C.with_label_error(Scratch(spark, "t"), coded, most).collect())) for most in (50_000, 0))
    assert a == b and len(a) == 101
    near = C.decode([r.code for r in coded.collect()], books)
    assert near.shape == (101, 32)


def brute_negatives(rows, anchor=50, relabel=True):
    kept = [(i, whole(v), c if i is None or i % 7 or not relabel else (c + 1) % 10) for i, v, c in rows if whole(v) is not None and c is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1])
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % anchor:
            continue
        scored = [(dot(v, w), j, c) for m, (j, w, c) in enumerate(kept) if m != k]
        for s, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            fits = sorted((x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s), key=order)
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(fits[:3])]
    return sorted(out, key=repr)


def mined(spark, path, **how):
    score = F.col("positive_score")
    from millrace.session import table

    low, high = F.ceil(score * F.lit("0.5").cast("decimal(2,1)")).cast("long"), F.floor(score * F.lit("0.95").cast("decimal(3,2)")).cast("long")
    got = H.mine(spark, table(spark, path, "embeddings"), F.col("vec_id") % 5 == 0, F.col("label"), low, high, **how)
    return sorted(map(tuple, got.collect()), key=repr)


def test_negatives_match_brute_force(spark, tmp_path):
    rows = odd_rows(400)
    got = H.op12_hard_negatives(spark, table_of(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_negatives(rows)


def test_small_cells_and_rounds_give_the_same(spark, tmp_path):
    rows = odd_rows(300) + [(None, [0.5] * 32, 2), (5, [0.25] * 32, 1), (5, [0.25] * 32, 1), (10, [0.7] * 3, 3), (15, [], 1)]
    got = mined(spark, table_of(spark, tmp_path, rows), round_=20, cell_rows=32)
    assert got == brute_negatives(rows, 5, False)


def test_negatives_of_nothing(spark, tmp_path):
    assert H.op12_hard_negatives(spark, table_of(spark, tmp_path / "a", [])).count() == 0
    assert H.op12_hard_negatives(spark, table_of(spark, tmp_path / "b", [(1, [0.5], 1), (2, [0.1], 1)])).count() == 0
    assert H.op12_hard_negatives(spark, table_of(spark, tmp_path / "c", [(50, [0.5], 1), (2, [0.1], 3)])).count() == 0


def test_tree_rules_out_leaves_where_vectors_have_structure():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 2, (256, 16)) for c in rng.normal(0, 200, (4, 16))]).astype(np.int64)
    space = H.Space(16, int((x * x).sum(1).max()))
    import pyarrow as pa

    t = pa.table({"row": np.arange(1024), "vec_id": np.arange(1024), "label": np.zeros(1024, np.int64), "vec": pa.array([r.astype("<i4").tobytes() for r in x], pa.binary())})
    part = H.Part(space, H._indexed(space)(t).to_pylist()[0])
    few = x[:1024:64]
    search = H.Search(space, np.arange(0, 1024, 64), np.zeros(16, np.int64), few, np.full((16, 1), H.LOWEST + 1), np.full((16, 1), H.HIGHEST), True, 5)
    search.visit(part)
    assert search.lookups < 0.6 * 16 * 1024
    brute = [sorted(((int(a @ b), j) for j, b in enumerate(x) if j != 64 * i), key=lambda s: (-s[0], s[1]))[:5] for i, a in enumerate(few)]
    assert [list(zip(s, r)) for s, r in zip(search.best.score.tolist(), search.best.id.tolist())] == [[(s, j) for s, j in b] for b in brute]
