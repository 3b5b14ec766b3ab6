"""Operators that work in rounds over whole tables, against small exact versions; constants are set low, so that every path runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, density, features, languages, linkage, near, sparse, suffixes
from millrace.operators import relational as rel
from millrace.session import Scratch
from millrace.sources import sinks


def blobs(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.5, (n // 5, d)) for c in rng.normal(0, 3, (4, d))] + [rng.uniform(-6, 6, (n - 4 * (n // 5), d))])
    x[5:25] = x[5]  # equal rows
    return x


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(range(len(x)) if ids is None else ids, x)], "id long, v array<double>")


def matrix(x, metric):
    return np.stack([np.abs(x - r).sum(1) if metric == "manhattan" else np.sqrt(((x - r) ** 2).sum(1)) for r in x])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_nearest_rows(spark, monkeypatch, metric):
    monkeypatch.setattr(near, "QUERY_ROWS", 100)
    x = blobs(300, 3)
    cells = near.Cells(Scratch(spark, "t"), frame(spark, x).withColumn("w", F.lit(0.0)), metric, 7, cell_rows=32)
    got = {}
    for r in near.nearest(cells, 7).collect():
        got.setdefault(r.a, []).append((r.d, r.b))
    d = matrix(x, metric)
    assert {a: sorted(v) for a, v in got.items()} == {i: sorted((d[i, j], j) for j in range(300) if j != i)[:7] for i in range(300)}


def test_hdbscan_equals_the_small_version(spark, monkeypatch):
    monkeypatch.setattr(near, "QUERY_ROWS", 200)
    monkeypatch.setattr(density, "DRIVER_ROWS", 50)
    x = blobs(400, 3)
    got = {r.id: r.cluster for r in density.hdbscan(frame(spark, x, 3 * np.arange(400)), "id", "v", 5, cell_rows=48).collect()}
    want = cluster.hdbscan_labels(x, 5)
    assert [got[3 * i] for i in range(400)] == want.tolist() and len(set(want)) > 3


def test_hdbscan_of_few_rows(spark):
    assert density.hdbscan(frame(spark, np.zeros((0, 2))), "id", "v", 3).count() == 0
    assert {r.cluster for r in density.hdbscan(frame(spark, np.zeros((2, 2))), "id", "v", 3).collect()} == {-1}
    assert {r.cluster for r in density.hdbscan(frame(spark, np.zeros((6, 2))), "id", "v", 3).collect()} == {-1}


def brute_dbscan(ids, x, eps, least):
    d = matrix(x, "euclidean")
    core, lab = (d <= eps).sum(1) >= least, {}
    for i in np.flatnonzero(core):
        if i not in lab:
            todo, comp, lab[i] = [i], [], -1
            while todo:
                a = todo.pop()
                comp.append(a)
                for b in np.flatnonzero((d[a] <= eps) & core):
                    if b not in lab:
                        lab[b] = -1
                        todo.append(b)
            lab.update(dict.fromkeys(comp, min(ids[c] for c in comp)))
    near_ = lambda i: [(d[i, j], lab[j]) for j in np.flatnonzero((d[i] <= eps) & core)]
    return {ids[i]: lab[i] if core[i] else min(near_(i))[1] if near_(i) else -1 for i in range(len(x))}


def test_dbscan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "QUERY_ROWS", 100)
    x = blobs(400, 3)
    ids = [int(i) for i in np.random.default_rng(2).permutation(400)]
    got = {r.id: r.cluster for r in density.dbscan(frame(spark, x, ids), "id", "v", 0.8, 4, cell_rows=64).collect()}
    want = brute_dbscan(ids, x, 0.8, 4)
    assert got == want and -1 in want.values() and len(set(want.values())) > 2


def test_a_dense_ball_needs_no_pairs(spark):
    x = np.random.default_rng(0).normal(0, 0.01, (6000, 3))
    got = density.dbscan(frame(spark, np.concatenate([x, [[9.0, 9, 9]]])), "id", "v", 0.3, 5).groupBy("cluster").count().collect()
    assert {(r.cluster, r["count"]) for r in got} == {(0, 6000), (-1, 1)}


def test_ward_equals_the_chain(spark, monkeypatch):
    monkeypatch.setattr(near, "QUERY_ROWS", 150)
    x = blobs(400, 4)[25:]
    got = {r.id: r.cluster for r in linkage.ward(frame(spark, x), "id", "v", 6.0, finish_rows=60, cell_rows=64).collect()}
    first, want = {}, cluster.ward_labels(x, 6.0).tolist()
    assert got == {i: first.setdefault(k, i) for i, k in enumerate(want)} and 4 < len(set(want)) < 200


def test_sparse_svd_against_the_dense_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    rows = sparse.layout(features.hashed_vectors(docs.fillna("", ["text"]), "text"), "doc_id", "features")
    got = rows.collect()
    columns = sorted({c for r in got for c in r.indices})
    at, dense = {c: i for i, c in enumerate(columns)}, np.zeros((len(got), len(columns)))
    for n, r in enumerate(got):
        for c, v in zip(r.indices, r["values"]):
            dense[n, at[c]] = v
    _, exact, turn = np.linalg.svd(dense, full_matrices=False)
    values, components = sparse.svd(rows, 1 << 18, 5)
    assert np.abs(np.array(values) / exact[:5] - 1).max() < 0.01
    assert min(abs(float(components[k][columns] @ turn[k])) for k in range(4)) > 0.99
    along = (dense @ components[:, columns].T).var(0) / dense.var(0).sum()
    assert np.allclose(along, sparse.explained(rows, 1 << 18, components))


def test_sparse_layout_is_stored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "")], "doc_id long, text string")
    sinks.sparse_matrix(features.hashed_vectors(docs, "text"), "doc_id", "features", f"{tmp_path}/m")
    got = {r.id: dict(zip(r.indices, r["values"])) for r in spark.read.schema(sparse.LAYOUT).parquet(f"{tmp_path}/m").collect()}
    assert got[2] == {} and sorted(round(v * v, 9) for v in got[1].values()) == [0.2, 0.8]


@pytest.mark.parametrize("few", [3, 4096])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(rel, "FEW", few)
    monkeypatch.setattr(rel, "ACCURACY", 50 if few == 3 else 10_000)
    rng = np.random.default_rng(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for x in (rng.normal(0, 1e6, 3000), np.repeat([1.0, 2.0, 3.0], 700), np.concatenate([np.zeros(900), rng.exponential(1e300, 300), [-1e308]]), np.arange(5.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
        got = rel.quantiles(df, "x", shares)
        assert np.allclose(got, np.quantile(x, shares), rtol=1e-12)
        assert "ercentile(" not in rel.describe(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert rel.quantiles(df.filter("x > 1e9"), "x", [0.5]) == [None]


def test_chunks_are_those_of_ntile(spark, monkeypatch):
    monkeypatch.setattr(rel, "RANGE_ROWS", 10)
    for n, k in ((0, 3), (2, 5), (50, 7), (49, 7)):
        df = spark.createDataFrame([(i * 7919 % 101, i) for i in range(n)], "k long, v long")
        from pyspark.sql import Window

        want = df.withColumn("chunk", F.ntile(k).over(Window.orderBy("k", "v")))
        assert sorted(map(tuple, rel.chunked(df, ["k", "v"], k).collect())) == sorted(map(tuple, want.collect()))


def test_suffix_rules(spark):
    rules = spark.createDataFrame([(r,) for r in ("// a comment", "", "com", "*.ck", "!www.ck", "co.uk", "uk", "blogspot.com", None)], "rule string")
    want = {
        "a.b.example.com": ("com", "example.com"), "com": ("com", None), "x.blogspot.com": ("blogspot.com", "x.blogspot.com"), "blogspot.com": ("blogspot.com", None), "a.b.co.uk": ("co.uk", "b.co.uk"),
        "foo.ck": ("foo.ck", None), "a.foo.ck": ("foo.ck", "a.foo.ck"), "www.ck": ("ck", "www.ck"), "b.www.ck": ("ck", "www.ck"), "ck": ("ck", None), "a.b.unknown": ("unknown", "b.unknown"), "10.0.0.1": (None, "10.0.0.1"), "": (None, None), None: (None, None),
    }
    hosts = spark.createDataFrame([(h, 1) for h in want] * 2, "host string, n int")
    for most in (200_000, 0):
        out = suffixes.with_suffix(hosts, "host", rules, most).collect()
        assert len(out) == 2 * len(want) and {r.host: (r.suffix, r.domain) for r in out} == want


def test_cached_tables(spark, tmp_path):
    import os

    spark.range(10).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.read.parquet(f"{tmp_path}/in").filter("id > 3").withColumn("x", F.transform(F.array("id"), lambda v: v + 1))
    place = f"{tmp_path}/cache"
    assert sinks.cached(source(), place).count() == 6
    (one,) = os.listdir(place)
    files = sorted(os.listdir(f"{place}/{one}"))
    assert sinks.cached(source(), place).count() == 6 and sorted(os.listdir(f"{place}/{one}")) == files  # read, not written again
    os.remove(f"{place}/{one}/_SUCCESS")  # as a broken write leaves it
    for f in files:
        if f.endswith(".parquet"):
            os.remove(f"{place}/{one}/{f}")
    assert sinks.cached(source(), place).count() == 6 and os.path.exists(f"{place}/{one}/_SUCCESS")
    assert sinks.cached(source().filter("id > 5"), place).count() == 4 and len(os.listdir(place)) == 2  # another plan
    spark.range(20).write.mode("append").parquet(f"{tmp_path}/in")
    assert sinks.cached(source(), place).count() == 22 and len(os.listdir(place)) == 3  # another input
    with pytest.raises(ValueError, match="version"):
        sinks.cached(spark.createDataFrame([(1,)], "a int"), place)
    assert sinks.cached(spark.createDataFrame([(1,)], "a int"), place, version="1").count() == 1


def test_language_profiles_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)))
    model = languages.fit(docs.filter("fold <> 2"), "text", "lang")
    held = docs.filter("fold = 2 AND length(text) >= 64")
    got = languages.detect(held, "doc_id", "text", model).join(held.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    short = spark.createDataFrame([(1, "short text"), (2, None), (3, "7" * 80), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, languages.detect(short, "doc_id", "text", model).collect())) == [(1, None), (2, None), (3, None), (4, None)]


def test_tfidf_by_broadcast_and_by_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b, c = ({(r.doc_id, r.term): round(r.weight, 9) for r in features.tfidf(docs, "doc_id", "text", most).collect()} for most in (200_000, 60, 5))
    assert a == b == c and len(a) > 10_000


def test_best_cosine_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(cluster, "QUERY_ROWS", 7)
    x = blobs(60, 4)
    df = frame(spark, np.concatenate([x, [[0.0] * 4]]))
    got = {r.a: (r.n, r.best) for r in cluster.best_cosine(df, df.filter("id % 3 = 0"), "id", "v").collect()}
    u = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), [[0.0] * 4]])
    s = u @ u.T
    assert got.keys() == set(range(0, 61, 3))
    assert all(n == 60 and abs(best - max(s[a, j] for j in range(61) if j != a)) < 1e-12 for a, (n, best) in got.items())
