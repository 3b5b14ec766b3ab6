import numpy as np
from pyspark.sql import functions as F

from millrace.functions import measures
from millrace.operators import cluster, density, dom, features, scoring, series
from millrace.operators import relational as rel


def timer_rows(values, seconds=None):
    import datetime as dt

    return [(1, k, float(v), dt.datetime(2024, 1, 1, 0, 0, k if seconds is None else seconds)) for k, v in enumerate(values)]


def countdown(spark, values, seconds=None):
    df = spark.createDataFrame(timer_rows(values, seconds), "g long, id long, v double, ts timestamp")
    return series.countdowns(df, ["g"], ["ts", "id"], "v", "ts").first()


def test_timer(spark):
    r = countdown(spark, [59, 58, 57, 56, 55, 54])
    assert r.decreasing and r.by_mode and r.seconds and r.is_timer


def test_timer_rollover_is_not_decreasing(spark):
    r = countdown(spark, [3, 2, 1, 0, 59, 58, 57])
    assert (r.n_neg, r.n_pos, r.decreasing) == (5, 1, False)


def test_timer_needs_seconds_and_keys(spark):
    assert not countdown(spark, [9, 8, 7, 6, 5, 4], seconds=1).seconds
    none = spark.createDataFrame([(None, 1, 1.0, None)], "g long, id long, v double, ts timestamp")
    assert series.countdowns(none, ["g"], ["ts", "id"], "v", "ts").count() == 0


def test_mode_takes_the_least_of_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (1, 3), (1, 9)], "g long, v long")
    assert tuple(series.mode_of(df, ["g"], "v", "m").first()) == (1, 3, 2)


def test_single_candidate_scores_zero(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (2, 2, 9.0)], "page long, pos long, size double")
    rows = {(r.page, r.pos): r for r in scoring.ranked(df, "page", {"size": 1.0}, "pos", 0.5).collect()}
    assert rows[1, 1].score == 0 and not rows[1, 1].chosen and rows[2, 2].chosen and rows[2, 2].next_score == 0


def test_lookup_keeps_the_last(spark):
    table = spark.createDataFrame([("t", 3, 0), ("t", 7, 1)], "text string, cluster long, pos long")
    assert rel.lookup_last(spark.createDataFrame([("t",), ("u",)], "text string"), table, "text", "cluster", "pos").collect()[0].cluster == 7


def test_joins_partition_and_mark(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(2, "a"), (2, "b")], "o long, x string")
    marked = {r.k: r.m for r in rel.mark_join(left, right, "k", "o", "m").collect()}
    assert marked == {1: False, 2: True, None: False}
    semi, anti = (left.join(right.withColumnRenamed("o", "k"), "k", how).count() for how in ("left_semi", "left_anti"))
    assert semi + anti == left.count()


def test_dedup_is_idempotent_and_parts_add_up(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, k string")
    once = rel.keep_last(df, ["k"], ["id"])
    assert sorted(r.id for r in once.collect()) == [2, 3, 4]
    assert sorted(map(tuple, rel.keep_last(once, ["k"], ["id"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert sum(p.count() for p in rel.split_by_count(df, "k")) == 4
    cross = rel.crosstab(df.fillna("z"), "k", "id", [1, 2, 3, 4])
    assert cross.select(F.sum(F.col("n_1") + F.col("n_2") + F.col("n_3") + F.col("n_4"))).first()[0] == 4


def test_pattern_join_by_domain_and_text(spark):
    rows = spark.createDataFrame([("a.com", "http://x.a.com/t"), ("b.com", "http://b.com/widget.js"), (None, "zzz")], "d string, u string")
    got = sorted((r.provider, r.u) for r in rel.pattern_join(rows, [("A", "a.com"), ("W", "#widget")], "d", "u").collect())
    assert got == [("A", "http://x.a.com/t"), ("W", "http://b.com/widget.js")]


def test_first_match_wins(spark):
    df = spark.createDataFrame([("start end",), ("end",), ("x",)], "v string")
    assert [r.p for r in df.select(rel.first_match(F.col("v"), [("s", "start"), ("e", "end")]).alias("p")).collect()] == ["s", "e", None]


HTML = "<html><body><div id=a><p>One<p>Two <b>bold</b><ul><li>x<li>y</ul></div><script>no()</script><a href='/l' title=T>link</a><a href=/l>longer link</a><br><form action=/search><input type=hidden></form></body></html>"


def test_dom(spark):
    pages = spark.createDataFrame([(1, HTML, "u"), (2, None, "u"), (3, "", "u"), (4, "<p>open <b>tags", "u")], "page_id long, html string, path string")
    nodes = {(r.page_id, r.path): r for r in dom.nodes(pages).collect()}
    assert nodes[1, "/html[1]/body[1]/div[1]/p[2]"].text == "Two bold"
    assert nodes[1, "/html[1]/body[1]/div[1]/ul[1]/li[2]"].text == "y"
    assert nodes[1, "/html[1]/body[1]"].text.startswith("One") and "no()" not in nodes[1, "/html[1]/body[1]"].text
    assert nodes[4, "/p[1]/b[1]"].text == "tags" and not any(k[0] in (2, 3) for k in nodes)
    assert [r.text for r in dom.segments(pages.filter("page_id = 1")).collect()] == ["OneTwo boldxy"]
    assert [tuple(r) for r in dom.links(pages).collect()] == [(1, "/l", "longer link", "")]
    table = dom.nodes(pages)
    assert dom.search_forms(table).count() == 1
    leaves = {r.path for r in dom.without_nested(table.filter("page_id = 1 AND tag IN ('div', 'p', 'b', 'li')")).collect()}
    assert "/html[1]/body[1]/div[1]" not in leaves and "/html[1]/body[1]/div[1]/p[1]" in leaves and "/html[1]/body[1]/div[1]/p[2]" not in leaves
    hidden = table.filter("tag = 'input'").select(dom.shown(F.col("tag"), F.col("attrs")).alias("s"), dom.interactable(F.col("tag"), F.col("attrs")).alias("i")).first()
    assert (hidden.s, hidden.i) == (False, True)
    d = spark.range(1).select(dom.tree_distance(F.lit("/a[1]/b[1]/c[1]"), F.lit("/a[1]/b[2]")).alias("d")).first().d
    assert d == 3


def test_option_combinations(spark):
    df = spark.createDataFrame([(["s", "m"], ["red"])], "size array<string>, colour array<string>")
    assert sorted(r.combination for r in dom.option_combinations(df, ["size", "colour"]).collect()) == [["m", "red"], ["s", "red"]]


def two_blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3)), [[50, 50, 50]]])


def test_clusterings(spark):
    x = two_blobs()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.cluster for r in density.dbscan(df, "id", "v", 1.0, 3).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {20} and got[40] == -1
    link = {r.id: r.cluster for r in cluster.single_linkage(df, "id", "v", 1.0).collect()}
    assert len(set(link.values())) == 3 and link[40] == 40
    labels = cluster.hdbscan_labels(x, 5)
    assert len(set(labels[:20])) == 1 and len(set(labels[20:40])) == 1 and labels[0] != labels[20] and labels[40] == -1
    ward = cluster.ward_labels(x, 5.0)
    assert len(set(ward)) == 3 and ward[0] == ward[19] != ward[20]


def test_quality_measures_agree_with_numpy(spark):
    x = two_blobs()[:40]
    y = [0] * 20 + [1] * 20
    df = spark.createDataFrame([(i, y[i], v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = [(lambda a, b: (b - a) / max(a, b))(d[i][[j for j in range(40) if y[j] == y[i] and j != i]].mean(), d[i][[j for j in range(40) if y[j] != y[i]]].mean()) for i in range(40)]
    assert abs(cluster.silhouette(df, "id", "label", "v").first().score - np.mean(s)) < 1e-5
    c = [x[:20].mean(0), x[20:].mean(0)]
    w = sum(((x[i] - c[y[i]]) ** 2).sum() for i in range(40))
    b = sum(20 * ((m - x.mean(0)) ** 2).sum() for m in c)
    assert abs(cluster.calinski_harabasz(df, "label", "v").first().score - b / (w / 38)) < 1e-2
    spread = [np.sqrt(((x[k * 20 : k * 20 + 20] - c[k]) ** 2).sum(1)).mean() for k in (0, 1)]
    assert abs(cluster.davies_bouldin(df, "label", "v").first().score - sum(spread) / np.linalg.norm(c[0] - c[1])) < 1e-5


def test_link_model(spark):
    url = "http://shop.example.com/product/red-shoe/12345"
    row = spark.createDataFrame([(url,)], "u string").select(*(c.alias(n) for n, c in features.link_features(F.col("u")).items()), features.product_likelihood(F.col("u")).alias("p")).first()
    assert tuple(row)[:6] == (23, 1, 3, 1, 0, 1)
    z = measures.INTERCEPT + sum(w * v for w, v in zip(measures.COEFFICIENTS, [23, (1 - 1.902777777778) / 2.076052090857, (3 - 1.763888888889) / 1.073585057898, 1, 0, 1]))
    assert abs(row.p - 1 / (1 + np.exp(-z))) < 1e-9


def test_pattern_score(spark):
    t = spark.range(1).select(scoring.pattern_score(scoring.ADD_TO_CART, F.lit("Add to Cart"), F.lit("/x"), F.lit(None).cast("string"), F.lit("add-to-bag"), F.lit("")).alias("s")).first().s
    assert abs(t - 8 / 21) < 1e-12
    assert spark.range(1).select(scoring.is_product_page(F.lit("<a>ADD TO CART</a>")).alias("p"), scoring.is_product_page(F.lit("add to cart add to bag")).alias("q")).first() == (True, False)


def test_layout_functions(spark):
    lit = [F.lit(v) for v in (0, 0, 4, 2, 5, 0, 4, 4)]
    style = F.create_map(*(F.lit(x) for x in ("display", "block", "visibility", "visible", "position", "fixed", "z-index", "9")))
    row = spark.range(1).select(
        measures.seam_degree(*lit).alias("seam"), measures.in_box(F.lit(1), F.lit(1), F.lit(5), F.lit(5), (1, 1), (9, 9)).alias("box"),
        measures.in_popup(style, F.lit(40), F.lit(40), F.lit(20), F.lit(20), F.lit(100), F.lit(100)).alias("popup"),
        measures.in_popup(style, F.lit(0), F.lit(0), F.lit(2), F.lit(2), F.lit(100), F.lit(100)).alias("corner"),
    ).first()
    assert tuple(row) == (1.0, True, 1, 0)


def test_signing(spark):
    import base64
    import hashlib
    import hmac

    from millrace.functions import signing

    row = spark.createDataFrame([({"b": "x y", "a": "1/2"}, "k", "m")], "p map<string,string>, k string, m string").select(signing.canonical_query(F.col("p")).alias("q"), signing.hmac_sha256("k", "m").alias("h")).first()
    assert row.q == "a=1%2F2&b=x%20y"
    assert row.h == base64.b64encode(hmac.new(b"k", b"m", hashlib.sha256).digest()).decode()


def test_similar_blocks_split_unlike_children(spark):
    html = "<div><p>" + "long text " * 30 + "</p><a href=/a></a></div>"
    pages = spark.createDataFrame([(1, html), (2, "<ul><li>one</li><li>two</li></ul>")], "page_id long, html string")
    got = sorted((r.page_id, r.path) for r in dom.similar_blocks(dom.nodes(pages), dom.content_vectors(pages)).collect())
    assert got == [(1, "/div[1]/a[1]"), (1, "/div[1]/p[1]"), (2, "/ul[1]")]


def test_ordered_split_of_a_wide_table(spark, tmp_path):
    wide = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.lit("x").alias("b"))
    split = rel.ordered_split(wide, "k", 0.5)
    split.write.parquet(f"{tmp_path}/split")
    head = spark.read.parquet(f"{tmp_path}/split").filter("in_head")
    assert head.agg(F.count("*"), F.max("k")).first() == (100_000, 99_999)


def test_positional_join_takes_rows_by_place(spark):
    one = spark.createDataFrame([(k * 3, f"r{k}") for k in range(50)], "k long, a string").repartition(5)
    two = spark.createDataFrame([(k * k, f"l{k}") for k in range(60)], "j long, b string").repartition(3)
    got = rel.positional_join(one, two, "k", "j").collect()
    assert len(got) == 50 and all(r.a[1:] == r.b[1:] for r in got)


def test_running_concat(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("u", 3, None), ("v", 1, "c")], "k string, n long, x string")
    got = {(r.k, r.n): r.so_far for r in series.running_concat(df, "k", "n", "x").collect()}
    assert got == {("u", 1): "a", ("u", 2): "ab", ("u", 3): "ab", ("v", 1): "c"}


def test_segments_are_of_the_fixed_blocks(spark):
    html = "<div><p>one</p><section>two</section></div><ul><li>three</li></ul><nav>four</nav>"
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    assert sorted((r.tag, r.text) for r in dom.segments(pages).collect()) == [("nav", "four"), ("section", "two")]


def test_large_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cluster, "GROUP_ROWS", 5)
    df = spark.createDataFrame([(0, k, [float(k), 0.0]) for k in range(6)], "g long, id long, v array<double>")
    import pytest

    with pytest.raises(Exception, match="at most are clustered"):
        cluster.grouped(df, "g", "id", "v", lambda x: [0] * len(x)).collect()


def test_word_vectors_are_means(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b"), (4, "a b a b"), (5, None)], "id long, text string")
    got = {r.id: np.array(r.features.toArray()) for r in features.word_vectors(df, "text", 4).collect()}
    assert np.allclose(got[1], (got[2] + got[3]) / 2) and np.allclose(got[1], got[4]) and not got[5].any()


def test_components_agree_with_numpy(spark):
    x = np.random.default_rng(3).normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 0.3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "id int, v array<double>")
    values, components, shares = features.truncated_svd(df, "v", 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:3])
    assert np.allclose(np.abs((components * vt[:3]).sum(axis=1)), 1)
    assert np.allclose(shares, (x @ vt[:3].T).var(axis=0) / x.var(axis=0).sum())
    got = {r.id: r.p for r in features.projected(df, "v", components, "p").select("id", "p").collect()}
    assert np.allclose([got[k] for k in range(200)], x @ components.T) and got[999] == [None] * 3
    centred = np.linalg.svd(x - x.mean(axis=0))[1] ** 2
    shares, rows = features.principal_components(df, "v", 4)
    assert np.allclose(shares, (centred / centred.sum())[:4]) and rows.shape == (4, 5)
    assert len(features.principal_components(df, "v", 0.9)[0]) == int(np.searchsorted(np.cumsum(centred / centred.sum()), 0.9)) + 1
    assert np.allclose(features.component_cosines(components, components), 1)
    assert features.component_cosines(np.zeros((1, 5)), components[:1]) == [0.0]


def test_moments_of_nothing(spark):
    assert features.truncated_svd(spark.createDataFrame([], "v array<double>"), "v", 2)[0] == []


def test_samples_are_whole_and_repeat(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 3, "few").otherwise("many"))
    one, two = ([r.id for r in rel.hash_sample(df, "id", 10).collect()] for _ in range(2))
    assert one == two and len(set(one)) == 10 and one != list(range(10))
    assert [r.id for r in rel.hash_sample(df, "id", 10, seed=1).collect()] != one
    per = rel.sample_per_group(df, "g", "id", 5).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in per} == {"few": 3, "many": 5}


def test_elapsed_minutes(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS a, timestamp'2024-01-01 11:30:15' AS b")
    assert df.select(series.elapsed_minutes(F.col("a"), F.col("b")).alias("m")).first().m == 90.25


def test_search_handles(spark):
    pages = [
        (1, "<form id=login><input name=u></form><form class=SiteSearch><input type=text><input type=search><button>a</button><input type=submit></form>"),
        (2, "<div><form><input title='srch me'><button>x</button><button>y</button></form></div>"),
        (3, "<form action=/search><button>go</button></form><form><input title=search></form>"),
        (4, "<form role=query><p><input></p></form>"),
        (5, None),
    ]
    got = {r.page_id: (r.form, r.box, r.button) for r in dom.search_handles(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {
        1: ("/form[2]", "/form[2]/input[2]", "/form[2]/input[3]"),
        2: ("/div[1]/form[1]", "/div[1]/form[1]/input[1]", "/div[1]/form[1]/button[1]"),
        4: ("/form[1]", "/form[1]/p[1]/input[1]", None),
    }


def test_select_options(spark):
    html = "<select><option>Choose a size<option>S<option selected>M</select><select><option>1<option>2</select><select></select>"
    got = dom.select_options(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert sorted((r.path, r.option, r.text) for r in got) == [("/select[1]", "/select[1]/option[2]", "S"), ("/select[1]", "/select[1]/option[3]", "M")]


def test_trigger_lists(spark):
    schema = "page_id long, path string"
    triggers = spark.createDataFrame([(1, "/div[1]/span[1]"), (1, "/div[2]/a[1]"), (1, "/p[1]"), (2, "/div[1]/span[1]")], schema)
    lists = spark.createDataFrame([(1, "/div[1]/ul[1]"), (1, "/div[1]/p[1]/ol[1]"), (1, "/div[2]"), (1, "/ul[1]"), (2, "/div[1]/span[1]/dl[1]")], schema)
    got = sorted(tuple(r) for r in dom.trigger_lists(triggers, lists).collect())
    assert got == [(1, "/div[1]/span[1]", "/div[1]/p[1]/ol[1]"), (1, "/div[1]/span[1]", "/div[1]/ul[1]"), (2, "/div[1]/span[1]", "/div[1]/span[1]/dl[1]")]
