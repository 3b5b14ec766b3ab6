"""All registered queries of the analytics engine and their oracle SQL, by key.

Each query reads whole driver tables. `@query(sql)` registers a query with the DuckDB statement that gives
the same rows; without SQL it is tested in tests/."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists, measures, text, urls
from ..operators import cluster, density, dom, features, languages, layout, linkage, popups, scoring, series, sparse, suffixes
from ..operators import relational as rel
from ..session import Scratch, table
from ..streaming import visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Segments: the lines of documents; site = source, visit = doc_id, in order of line."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


LINES = """lines AS (
  SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""


# ---------------------------------------------------------------- segments: dedup and joins


@query(f"""WITH {LINES},
kept AS (SELECT source, doc_id, line_no, regexp_replace(replace(replace(trim(line), chr(10), ' '), chr(13), ''), '[0-9]+', 'DPNUM', 'g') AS masked FROM lines WHERE trim(line) <> ''),
first AS (SELECT *, row_number() OVER (PARTITION BY source, masked ORDER BY doc_id, line_no) AS nth FROM kept)
SELECT source, count(*) AS n_segments, sum(length(masked))::BIGINT AS n_chars FROM first WHERE nth = 1 GROUP BY source""")
def segment_dedup(spark, sf):
    kept = lines(spark, sf).filter(F.trim("line") != "").withColumn("masked", text.mask_digits(text.one_line(F.trim("line"))))
    first = kept.groupBy("source", "masked").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    return first.groupBy("source").agg(F.count("*").alias("n_segments"), F.sum(F.length("masked")).alias("n_chars"))


@query(f"""WITH {LINES}, masked AS (SELECT source, doc_id, line_no, regexp_replace(line, '[0-9]+', 'DPNUM', 'g') AS masked FROM lines)
SELECT source, masked, doc_id, line_no::INT AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY source, masked ORDER BY doc_id DESC, line_no DESC) AS nth FROM masked) WHERE nth = 1""")
def segment_keep_last(spark, sf):
    masked = lines(spark, sf).withColumn("masked", text.mask_digits(F.col("line")))
    last = masked.groupBy("source", "masked").agg(F.max(F.struct("doc_id", "line_no")).alias("at"))
    return last.select("source", "masked", "at.doc_id", "at.line_no")


@query("""SELECT user_id, event_type, k, event_id, value FROM (
  SELECT *, props::JSON->>'k' AS k, row_number() OVER (PARTITION BY user_id, event_type, props::JSON->>'k' ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""")
def keep_last_multi_key(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rel.keep_last(e, ["user_id", "event_type", "k"], ["ts", "event_id"]).select("user_id", "event_type", "k", "event_id", "value")


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lower(d.lang) <> 'fr' AND trim(d.text) <> ''""")
def left_join_site(spark, sf):
    d = table(spark, sf, "documents").filter((F.lower("lang") != "fr") & (F.trim("text") != "")).select("doc_id", "source")
    return d.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("""SELECT o.o_orderkey, o.o_custkey AS custkey_1, c.c_custkey AS custkey_2, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def inner_join_suffix(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("o_custkey").alias("custkey_1"), F.col("c_custkey").alias("custkey_2"), "c_mktsegment")


@query("""SELECT c.c_custkey, n.n_name, o.o_orderkey, row_number() OVER (ORDER BY o.o_totalprice DESC, o.o_orderkey) AS place
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 490000 AND c.c_mktsegment = 'BUILDING'""")
def merge_filter_rank(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 490000")
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    n = table(spark, sf, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    # a ranked report: the filters leave few rows
    return j.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")).select("c_custkey", "n_name", "o_orderkey", "place")


BIG = "o_totalprice > 450000"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {BIG})")
def semi_membership(spark, sf):
    big = table(spark, sf, "orders").filter(BIG).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {BIG})")
def anti_membership(spark, sf):
    big = table(spark, sf, "orders").filter(BIG).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(f"SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE {BIG}) AS has_big, count(*) AS n FROM customer GROUP BY ALL")
def mark_join_flag(spark, sf):
    marked = rel.mark_join(table(spark, sf, "customer"), table(spark, sf, "orders").filter(BIG), "c_custkey", "o_custkey", "has_big")
    return marked.groupBy("c_mktsegment", "has_big").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, t AS (SELECT split_part(text, ' ', 1) AS word, max_by(item_id, item_id) AS item_id FROM benchmark GROUP BY 1)
SELECT doc_id, line_no::INT AS line_no, t.item_id FROM lines JOIN t ON split_part(line, ' ', 1) = t.word""")
def broadcast_lookup_last(spark, sf):
    known = table(spark, sf, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("word"), "item_id", F.col("item_id").alias("pos"))
    rows = lines(spark, sf).withColumn("word", F.split_part("line", F.lit(" "), F.lit(1)))
    return rel.lookup_last(rows, known, "word", "item_id", "pos").select("doc_id", "line_no", "item_id")


# ---------------------------------------------------------------- third parties and URLs

HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
DOMAIN = f"regexp_extract({HOST}, '([^.]+[.][^.]+)$', 1)"
PATTERNS = [("net sites", "example.net"), ("org sites", "example.org"), ("blogs", "#blog."), ("english", "#/en/")]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as requests: visit_id is the remainder of page_id by 25, and the page of that id is the visited site."""
    p = table(spark, sf, "pages").select("page_id", "url")
    site = p.select(F.col("page_id").alias("visit_id"), F.col("url").alias("site_url"))
    r = p.withColumn("visit_id", F.pmod("page_id", F.lit(25))).join(site, "visit_id", "left")
    return r.withColumn("request_domain", urls.registrable_domain(urls.hostname(F.col("url")))).withColumn("site_host", urls.hostname(F.col("site_url")))


REQUESTS = f"""r AS (SELECT p.page_id, p.url, s.url AS site_url, {DOMAIN.replace('url', 'p.url')} AS request_domain, {HOST.replace('url', 's.url')} AS site_host, {DOMAIN.replace('url', 's.url')} AS site_domain
  FROM pages p LEFT JOIN pages s ON s.page_id = p.page_id % 25)"""


@query(f"""WITH {REQUESTS}, hits AS (
  SELECT 'net sites' AS provider, site_host FROM r WHERE request_domain = 'example.net' UNION ALL SELECT 'org sites', site_host FROM r WHERE request_domain = 'example.org'
  UNION ALL SELECT 'blogs', site_host FROM r WHERE contains(url, 'blog.') UNION ALL SELECT 'english', site_host FROM r WHERE contains(url, '/en/'))
SELECT provider, count(DISTINCT site_host) AS n_sites, string_agg(DISTINCT site_host, chr(9) ORDER BY site_host) AS sites FROM hits GROUP BY provider""")
def pattern_theta_join(spark, sf):
    hits = rel.pattern_join(requests(spark, sf), PATTERNS, "request_domain", "url")
    return hits.groupBy("provider").agg(F.count_distinct("site_host").alias("n_sites"), F.array_join(F.sort_array(F.collect_set("site_host")), "\t").alias("sites"))


REGEXES = [("mobile", "^m[.]"), ("paged", "[?&]page=[0-9]+"), ("long number", "/[0-9]{3,}")]


@query("SELECT name, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, split_part(url, '://', -1) AS rest FROM pages) p, (VALUES " + ", ".join(f"('{n}', '{r}')" for n, r in REGEXES) + ") t(name, rx) WHERE regexp_matches(rest, rx) GROUP BY name")
def regex_pattern_join(spark, sf):
    rest = table(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "://"), -1).alias("rest"))
    named = rest.select("page_id", F.explode(F.filter(F.array(*(F.when(F.col("rest").rlike(r), n) for n, r in REGEXES)), lambda x: x.isNotNull())).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"""SELECT page_id, {HOST} AS host, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc, split_part(split_part(regexp_replace(url, '^[^:/?#]+://', ''), '#', 1), '?', 1) AS base_url, ltrim({HOST}, 'w.') AS stripped FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.hostname(u).alias("host"), urls.netloc(u).alias("netloc"), urls.base_url(u).alias("base_url"), urls.strip_www_letters(urls.hostname(u)).alias("stripped"))


@query(f"WITH {REQUESTS} SELECT page_id, request_domain, site_domain, request_domain <> site_domain AS third_party FROM r")
def registrable_domain(spark, sf):
    r = requests(spark, sf).withColumn("site_domain", urls.registrable_domain(F.col("site_host")))
    return r.select("page_id", "request_domain", "site_domain", urls.third_party(F.col("request_domain"), F.col("site_domain")).alias("third_party"))


@query(f"""WITH {REQUESTS} SELECT request_domain, string_agg(DISTINCT site_host, chr(9) ORDER BY site_host) AS publishers, count(DISTINCT site_host) AS n_publishers FROM r WHERE request_domain <> site_domain GROUP BY request_domain""")
def third_party_bipartite(spark, sf):
    r = requests(spark, sf).filter(F.col("request_domain") != urls.registrable_domain(F.col("site_host")))
    return r.groupBy("request_domain").agg(F.array_join(F.sort_array(F.collect_set("site_host")), "\t").alias("publishers"), F.count_distinct("site_host").alias("n_publishers"))


GLUED = "regexp_replace(regexp_replace(regexp_replace(url, '^[^:/?#]+://[^/?#]*', ''), '#', ''), '[?]', '')"
LINK_SQL = f"""SELECT page_id, least(length(p), 100) AS path_len, length(p) - length(replace(p, '-', '')) AS num_hyphen,
  length(rtrim(p, '/')) - length(replace(rtrim(p, '/'), '/', '')) AS num_slash, contains(p, 'product')::BIGINT AS contains_product, contains(p, 'category')::BIGINT AS contains_category,
  (len(list_filter(regexp_extract_all(p, '[0-9]+'), lambda x: length(x) > 3 AND length(x) < 32)) > 0)::BIGINT AS contains_pid FROM (SELECT page_id, {GLUED} AS p FROM pages)"""


@query(LINK_SQL)
def url_features(spark, sf):
    return table(spark, sf, "pages").select("page_id", *(c.alias(n) for n, c in features.link_features(F.col("url")).items()))


def _scaled_sql(name: str) -> str:
    return f"(({name} - {measures.SCALER[name][0]}) / {measures.SCALER[name][1]})" if name in measures.SCALER else name


@query(f"SELECT page_id, round(1 / (1 + exp(-({measures.INTERCEPT}" + "".join(f" + {_scaled_sql(n)} * {w}" for n, w in zip(features.LINK_FEATURES, measures.COEFFICIENTS)) + f"))), 9) AS p_product FROM ({LINK_SQL})")
def product_likelihood(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.round(features.product_likelihood(F.col("url")), 9).alias("p_product"))


# ---------------------------------------------------------------- aggregations


@query("SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def group_count_desc(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "o_orderpriority")).cast("long"))


@query("SELECT l_returnflag, count(l_suppkey) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1")
def count_and_nunique(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("l_suppkey").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_combos(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY 1")
def bool_or_per_key(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


@query("SELECT o_orderkey, o_custkey, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 15")
def having_keep_rows(spark, sf):
    return rel.with_group_size(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "n").filter("n > 15")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 4")
def having_single(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.count("*").alias("n")).filter("n = 4").drop("n")


@query("""WITH b AS (SELECT ceil(o_totalprice / 10000)::BIGINT AS bin, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hit FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 400000 GROUP BY 1)
SELECT k::BIGINT AS bin, coalesce(n, 0) AS n, round(100.0 * hit / nullif(n, 0), 6) AS pct FROM range(1, 41) t(k) LEFT JOIN b ON b.bin = k""")
def rank_bin_percentage(spark, sf):
    bins = table(spark, sf, "orders").withColumn("bin", measures.right_closed_bin(F.col("o_totalprice"), 10000, 40)).filter("bin IS NOT NULL")
    per = bins.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hit"))
    return spark.range(1, 41).withColumnRenamed("id", "bin").join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.try_divide(F.lit(100.0) * F.col("hit"), F.col("n")), 6).alias("pct"))


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, chr(9) ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def set_collect_join(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "\t").alias("flags"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY 1")
def list_collect_struct(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.col("t.role"), ",").alias("roles"), F.array_join(F.col("t.text"), "\n\n").alias("dialogue"))


@query("SELECT c_nationkey, unnest(range(1, n, 20))::INT AS start FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) WHERE n > 1")
def listing_pages(spark, sf):
    from ..sources.readers import listing_offsets

    return listing_offsets(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n").select("c_nationkey", "start")


@query("SELECT l_orderkey, max(l_extendedprice) AS area, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1")
def max_by_area(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("area"), F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("l_linenumber"))


@query("""SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS least,
  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS most FROM lineitem""")
def describe_numeric(spark, sf):
    return rel.describe(table(spark, sf, "lineitem"), "l_extendedprice")


def _digit_events(spark, sf):
    return table(spark, sf, "events").withColumn("v", F.floor("value").cast("long"))


DIFFS = "d AS (SELECT user_id, event_type, ts, event_id, floor(value)::BIGINT AS v, floor(value)::BIGINT - lag(floor(value)::BIGINT) OVER w AS diff FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"


@query(f"""WITH {DIFFS}, c AS (SELECT user_id, event_type, diff, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, arg_min(diff, (-n, diff)) AS mode, max(n) AS n_mode FROM c GROUP BY ALL""")
def mode_of_diffs(spark, sf):
    d = series.with_difference(_digit_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "v")
    return series.mode_of(d, ["user_id", "event_type"], "diff", "mode")


@query("SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events")
def time_gaps(spark, sf):
    return series.with_gap_seconds(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "ts").select("event_id", "gap")


@query(f"""WITH {DIFFS}, s AS (SELECT user_id, event_type, count(*) FILTER (diff < 0) AS n_neg, count(*) FILTER (diff > 0) AS n_pos, count(DISTINCT v) AS vals, count(DISTINCT date_trunc('second', ts)) AS secs FROM d GROUP BY ALL),
c AS (SELECT user_id, event_type, diff, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY ALL),
m AS (SELECT user_id, event_type, arg_min(diff, (-n, diff)) AS mode, max(n) FILTER (diff < 0) AS n_fall FROM c GROUP BY ALL),
f AS (SELECT s.user_id, s.event_type, n_neg, n_pos, n_neg >= 5 AND (n_pos = 0 OR n_neg > 5 * n_pos) AS decreasing,
  vals >= 5 AND n_neg >= 5 AND (n_pos = 0 OR coalesce(mode <= 0 AND coalesce(n_fall, 0) >= 5 AND n_neg > n_pos, false)) AS by_mode, secs >= 5 AS seconds FROM s LEFT JOIN m USING (user_id, event_type))
SELECT *, decreasing AND by_mode AND seconds AS is_timer FROM f""")
def timer_detection(spark, sf):
    return series.countdowns(_digit_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "v", "ts")


@query("""SELECT quality, count(*) FILTER (long_text) AS n_true, count(*) FILTER (NOT long_text) AS n_false FROM labels JOIN (SELECT doc_id, n_chars > 1000 AS long_text FROM documents) USING (doc_id) GROUP BY 1""")
def crosstab_agreement(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "true").otherwise("false").alias("long_text"))
    return rel.crosstab(table(spark, sf, "labels").join(d, "doc_id"), "quality", "long_text", ["true", "false"])


@query("""SELECT coalesce(avg((p = toxic)::INT), -1) AS overall, coalesce(avg((p = toxic)::INT) FILTER (toxic = 1), -1) AS on_positive, coalesce(avg((p = toxic)::INT) FILTER (toxic = 0), -1) AS on_negative, coalesce(avg((p = toxic)::INT) FILTER (toxic = 7), -1) AS on_none
FROM (SELECT toxic, 1 - quality AS p FROM labels)""")
def accuracy_split(spark, sf):
    hit = (1 - F.col("quality") == F.col("toxic")).cast("double")
    part = lambda c, n: F.coalesce(F.avg(F.when(c, hit)), F.lit(-1.0)).alias(n)
    return table(spark, sf, "labels").agg(part(F.lit(True), "overall"), part(F.col("toxic") == 1, "on_positive"), part(F.col("toxic") == 0, "on_negative"), part(F.col("toxic") == 7, "on_none"))


@query("SELECT props::JSON->>'k' AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_histogram(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


KEYWORDS = ["the", "and", "und", "que"]


@query("WITH h AS (SELECT source, doc_id, " + " + ".join(f"contains(lower(text), '{k}')::INT" for k in KEYWORDS) + " AS hits, n_chars FROM documents) SELECT source, arg_min(doc_id, (-hits, doc_id)) AS doc_id, max(hits)::BIGINT AS hits FROM h GROUP BY source")
def keyword_top_hit(spark, sf):
    hits = sum((F.contains(F.lower("text"), F.lit(k)).cast("long") for k in KEYWORDS), F.lit(0))
    return table(spark, sf, "documents").withColumn("hits", hits).groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("hits"), F.col("doc_id"))).alias("doc_id"), F.max("hits").alias("hits"))


@query("""WITH e AS (SELECT l_suppkey, greatest(0, max(l_quantity)) AS w, greatest(0, max(l_extendedprice)) AS h FROM lineitem GROUP BY 1)
SELECT l_suppkey, sum((l_quantity < w * 0.2)::INT)::BIGINT AS x_low, sum((l_quantity >= w * 0.2 AND l_quantity <= w * 0.8)::INT)::BIGINT AS x_mid, sum((l_quantity > w * 0.8)::INT)::BIGINT AS x_high,
  sum((l_extendedprice < h * 0.1)::INT)::BIGINT AS y_low, sum((l_extendedprice >= h * 0.1 AND l_extendedprice <= h * 0.9)::INT)::BIGINT AS y_mid, sum((l_extendedprice > h * 0.9)::INT)::BIGINT AS y_high FROM lineitem JOIN e USING (l_suppkey) GROUP BY 1""")
def page_extent_bins(spark, sf):
    li = table(spark, sf, "lineitem")
    ext = li.groupBy("l_suppkey").agg(F.greatest(F.lit(0.0), F.max("l_quantity")).alias("w"), F.greatest(F.lit(0.0), F.max("l_extendedprice")).alias("h"))
    j = li.join(ext, "l_suppkey")
    names = ["x_low", "x_mid", "x_high", "y_low", "y_mid", "y_high"]
    cols = measures.third_bins(F.col("l_quantity"), F.col("w"), 0.2, 0.8) + measures.third_bins(F.col("l_extendedprice"), F.col("h"), 0.1, 0.9)
    return j.groupBy("l_suppkey").agg(*(F.sum(c).alias(n) for c, n in zip(cols, names)))


@query("SELECT count(*) AS first_rows, (sum(n) - count(*))::BIGINT AS repeated_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def duplicate_audit(spark, sf):
    return rel.duplicate_audit(table(spark, sf, "documents"), "text")


# ---------------------------------------------------------------- sessions, candidates, chunks

PHASES = ["view", "click", "purchase", "signup", "error"]


@query("SELECT user_id, " + ", ".join(f"arg_max(ts, (ts, event_id)) FILTER (event_type = '{p}') AS \"{p}\"" for p in PHASES) + " FROM events GROUP BY 1")
def session_pivot(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == p, F.col("ts"))).alias(p) for p in PHASES))


@query("SELECT user_id, event_type AS phase, max(ts) AS at FROM events GROUP BY ALL")
def session_unpivot(spark, sf):
    wide = session_pivot(spark, sf)
    pairs = ", ".join(f"'{p}', {p}" for p in PHASES)
    return wide.selectExpr("user_id", f"stack({len(PHASES)}, {pairs}) AS (phase, at)").filter("at IS NOT NULL")


@query("""WITH m AS (SELECT user_id, event_type, max(ts) AS t FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
u AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last_t, max(t) OVER () AS now_t FROM m)
SELECT user_id AS visit, event_type AS phase, date_trunc('milliseconds', t) AS "at" FROM u WHERE last_t + INTERVAL 30 MINUTE <= now_t - INTERVAL 1 HOUR""")
def visit_phases_stream(spark, sf):
    """The event table as a stream: the phases of each user that has been silent for half an hour when the watermark
    (an hour behind the last event) stands still."""
    # a pattern, since a stream takes a single file by no other name
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/[e]vents.parquet")
    scratch = Scratch(spark, "visits")
    return visits.saved(visits.visit_phases(stream, "user_id", "event_type", "ts"), scratch.path("out"), scratch.path("checkpoint"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce((l_quantity - min(l_quantity) OVER w) / nullif(max(l_quantity) OVER w - min(l_quantity) OVER w, 0), 0) AS q,
  coalesce((l_extendedprice - min(l_extendedprice) OVER w) / nullif(max(l_extendedprice) OVER w - min(l_extendedprice) OVER w, 0), 0) AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
r AS (SELECT *, round(0.0 + q * 0.4 + p * 0.6, 9) AS score FROM s), k AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS next_score FROM r WINDOW o AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_extendedprice))
SELECT l_orderkey, l_linenumber, score, rank::INT AS rank, next_score, rank = 1 AND score > 0.5 AS chosen FROM k""")
def minmax_rank_candidates(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return scoring.ranked(li, "l_orderkey", {"l_quantity": 0.4, "l_extendedprice": 0.6}, "tie", 0.5).select("l_orderkey", "l_linenumber", "score", "rank", "next_score", "chosen")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN sqrt(max(l_extendedprice) OVER (PARTITION BY l_orderkey)) < 1 THEN l_discount ELSE l_discount + sqrt(l_extendedprice) / sqrt(max(l_extendedprice) OVER (PARTITION BY l_orderkey)) END, 9) AS score FROM lineitem""")
def link_rank_score(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scoring.link_rank(None, "l_orderkey", "l_discount", "l_extendedprice"), 9).alias("score"))


@query("SELECT c_custkey, ntile(8) OVER (ORDER BY c_name, c_custkey)::INT AS chunk FROM customer")
def ntile_chunks(spark, sf):
    return rel.chunked(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 8).select("c_custkey", "chunk")


@query("SELECT doc_id, source FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 50")
def hash_sample(spark, sf):
    return rel.hash_sample(table(spark, sf, "documents"), "doc_id", 50).select("doc_id", "source")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 5")
def per_group_sample(spark, sf):
    return rel.sample_per_group(table(spark, sf, "documents"), "source", "doc_id", 5).select("source", "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.9) AS in_head FROM orders")
def ordered_split(spark, sf):
    return rel.ordered_split(table(spark, sf, "orders"), "o_orderkey", 0.9).select("o_orderkey", "in_head")


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) USING (n)")
def positional_zip_join(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_orderkey")
    return rel.positional_join(c, o, "c_custkey", "o_orderkey")


@query("SELECT user_id, event_id, string_agg(event_type, '|') OVER (PARTITION BY user_id ORDER BY event_id) AS so_far FROM events")
def running_concat(spark, sf):
    e = table(spark, sf, "events")
    return series.running_concat(e, "user_id", "event_id", "event_type", "|").select("user_id", "event_id", "so_far")


@query("SELECT 'customer' AS kind, count(*) AS n, round(sum(bal), 2) AS total FROM (SELECT c_acctbal AS bal FROM customer) UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2) FROM supplier")
def union_all_counts(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("total"))


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN 'single' ELSE 'repeated' END AS part FROM orders) GROUP BY 1")
def split_reunion(spark, sf):
    none, single, repeated = rel.split_by_count(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    parts = none.withColumn("part", F.lit("none")).unionByName(single.withColumn("part", F.lit("single"))).unionByName(repeated.withColumn("part", F.lit("repeated")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_suppkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "supplier").select("s_suppkey"))


# ---------------------------------------------------------------- text

STOP = ["the", "and", "of", "to", "is", "in", "a", "it"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
NORM_SQL = f"""list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', 'dpnum', 'g'), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({STOP_SQL}))"""


@query(f"SELECT doc_id, array_to_string(list_transform({NORM_SQL}, lambda w: CASE WHEN starts_with(w, 'dpnum') THEN 'dpnum' ELSE w END), ' ') AS normal FROM documents")
def text_normalise_a(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalised(F.col("text"), STOP).alias("normal"))


@query(f"""SELECT doc_id, array_to_string(list_transform({NORM_SQL}, lambda w: CASE WHEN starts_with(w, 'dpnum') THEN 'dpnum' ELSE w END), ' ') AS normal,
  (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 1)) > 0)::BIGINT AS caps FROM documents""")
def text_normalise_b(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalised(F.col("text"), STOP).alias("normal"), text.has_caps_word(F.col("text")).alias("caps"))


@query("""SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, length(text) - length(replace(text, 'e', '')) AS n_e, coalesce(list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))), 0) AS longest_run,
  (len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) > 3 AND length(x) < 32)) > 0)::BIGINT AS has_id FROM documents""")
def text_stats(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), text.line_count(c).alias("n_lines"), text.count_of(c, "e").alias("n_e"), text.longest_digit_run(c).alias("longest_run"), text.has_run_between(c, 3, 32).alias("has_id"))


TERMS = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"


@query(f"""WITH {TERMS}, d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM c JOIN d USING (term)),
w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM w)
SELECT doc_id, term, round(weight, 6) AS weight, rank::INT AS rank FROM k WHERE rank <= 3""")
def tfidf_top_terms(spark, sf):
    return features.tfidf_top(table(spark, sf, "documents"), "doc_id", "text", 3, 6)


@query(f"WITH {TERMS} SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n FROM c GROUP BY 1")
def bow_counts(spark, sf):
    return features.term_counts(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@query(f"WITH {TERMS}, n AS (SELECT term, sqrt(sum(tf * tf)) AS length FROM c GROUP BY 1) SELECT doc_id, round(sum(tf / length), 6) AS total FROM c JOIN n USING (term) GROUP BY 1")
def bow_column_normalised(spark, sf):
    v = features.column_normalised(features.term_counts(table(spark, sf, "documents"), "doc_id", "text"))
    return v.groupBy("doc_id").agg(F.round(F.sum("value"), 6).alias("total"))


# ---------------------------------------------------------------- vectors and clusters


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT a, count(*) AS n, round(max(s), 5) AS best FROM p GROUP BY 1""")
def cosine_self_join(spark, sf):
    """The vectors of every id divisible by 20 against all others, whatever their labels."""
    e = table(spark, sf, "embeddings")
    return cluster.best_cosine(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("best", F.round("best", 5))


@query("SELECT b.p_brand AS brand, r.r_name AS region, s.size FROM (SELECT DISTINCT p_brand FROM part) b, region r, (VALUES ('S'), ('M'), ('L')) s(size)")
def option_cartesian(spark, sf):
    regions = table(spark, sf, "region").agg(F.collect_set("r_name").alias("regions"))  # a handful
    brands = table(spark, sf, "part").select("p_brand").distinct().select(F.array("p_brand").alias("brands"))
    rows = brands.join(F.broadcast(regions)).withColumn("sizes", F.array(F.lit("S"), F.lit("M"), F.lit("L")))
    chosen = dom.option_combinations(rows, ["brands", "regions", "sizes"])
    return chosen.select(*(F.col("combination")[k].alias(n) for k, n in enumerate(("brand", "region", "size"))))


@query("SELECT label, count(*) AS n, label = 0 AS noise FROM embeddings GROUP BY 1")
def cluster_noise_counts(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("noise", F.col("label") == 0)


LONG = "l AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY ALL)"


@query(f"""WITH {LONG}, g AS (SELECT pos, avg(x) AS m FROM l GROUP BY 1), w AS (SELECT sum((x - m) ** 2) AS w FROM l JOIN c USING (label, pos)), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
b AS (SELECT sum(n.n * (c.m - g.m) ** 2) AS b FROM c JOIN g USING (pos) JOIN n USING (label)) SELECT round((b / ((SELECT count(*) FROM n) - 1)) / (w / ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n))), 6) AS score FROM w, b""")
def calinski_harabasz(spark, sf):
    return cluster.calinski_harabasz(table(spark, sf, "embeddings"), "label", "embedding")


@query(f"""WITH {LONG}, v AS (SELECT vec_id, label, sqrt(sum((x - m) ** 2)) AS d FROM l JOIN c USING (label, pos) GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM v GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(r), 6) AS score FROM (SELECT a, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY a)""")
def davies_bouldin(spark, sf):
    return cluster.davies_bouldin(table(spark, sf, "embeddings"), "label", "embedding")


@query("""WITH d AS (SELECT a.vec_id AS a, a.label AS la, b.label AS lb, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT a, la, max(d) FILTER (la = lb) AS inner_, min(d) FILTER (la <> lb) AS outer_ FROM d GROUP BY ALL) SELECT round(avg(CASE WHEN inner_ IS NULL THEN 0 ELSE (outer_ - inner_) / greatest(inner_, outer_) END), 6) AS score FROM s""")
def silhouette(spark, sf):
    return cluster.silhouette(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


def _linked_sql(near: str, nodes: str) -> str:
    """Least reachable node of each node over pairs (a, b), in DuckDB."""
    return f"""r AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, l.b FROM r JOIN {near} l ON r.b = l.a), roots AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1)"""


PAIRS = "p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query(f"""WITH RECURSIVE {PAIRS}, near AS MATERIALIZED (SELECT * FROM p WHERE d <= 0.9), core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) + 1 >= 3),
l AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), {_linked_sql("l", "core")},
border AS (SELECT a AS id, arg_min(root, (d, root)) AS root FROM near JOIN roots ON b = roots.id WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT vec_id AS id, coalesce(roots.root, border.root, -1) AS cluster FROM embeddings LEFT JOIN roots ON vec_id = roots.id LEFT JOIN border ON vec_id = border.id""")
def dbscan(spark, sf):
    return density.dbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.9, 3)


@query()
def hdbscan(spark, sf):
    return density.hdbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)


@query()
def ward_linkage(spark, sf):
    return linkage.ward(table(spark, sf, "embeddings"), "vec_id", "embedding", 1.5)


@query(f"""WITH RECURSIVE {PAIRS}, l AS MATERIALIZED (SELECT a, b FROM p WHERE d < 0.8), n AS (SELECT vec_id AS id FROM embeddings), {_linked_sql("l", "n")} SELECT id, root AS cluster FROM roots""")
def single_linkage(spark, sf):
    return cluster.single_linkage(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.8)


def _report(spark: SparkSession, name: str, values: list[float], shares: list[float]) -> DataFrame:
    rows = [(k, float(v), float(x), float(r)) for k, (v, x, r) in enumerate(zip(values, shares, np.cumsum(shares)))]
    return spark.createDataFrame(rows, f"component int, {name} double, share double, running double")


@query()
def svd(spark, sf):
    values, _, shares = features.truncated_svd(table(spark, sf, "embeddings"), "embedding", 8)
    return _report(spark, "singular_value", values, shares)


@query()
def text_svd(spark, sf):
    """Leading components of the hashed words of all documents, in 2^18 sparse columns."""
    words = features.hashed_vectors(table(spark, sf, "documents").fillna("", ["text"]), "text")
    rows = Scratch(spark, "text-svd").save(sparse.layout(words, "doc_id", "features"), "rows")
    values, components = sparse.svd(rows, 1 << 18, 8)
    return _report(spark, "singular_value", values, sparse.explained(rows, 1 << 18, components))


@query()
def svd_projection(spark, sf):
    e = table(spark, sf, "embeddings")
    found = features.projected(e, "embedding", features.truncated_svd(e, "embedding", 3)[1])
    return found.select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query()
def pca(spark, sf):
    shares, _ = features.principal_components(table(spark, sf, "embeddings"), "embedding", 8)
    return _report(spark, "variance_share", shares, shares)


@query()
def pca_by_share(spark, sf):
    """As few components as explain nine tenths of the variance."""
    shares, _ = features.principal_components(table(spark, sf, "embeddings"), "embedding", 0.9)
    return _report(spark, "variance_share", shares, shares)


@query()
def component_agreement(spark, sf):
    """Cosines of the first components of all vectors with those of the vectors of even ids."""
    e = table(spark, sf, "embeddings")
    sets = [features.truncated_svd(x, "embedding", 8)[1] for x in (e, e.filter("vec_id % 2 = 0"))]
    return spark.createDataFrame(list(enumerate(features.component_cosines(*sets))), "component int, cosine double")


@query()
def gmm(spark, sf):
    return features.gaussian_mixture(table(spark, sf, "embeddings"), "embedding", 5).select("vec_id", "prediction")


@query()
def logistic_cv(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    ready = features.hashed_vectors(features.grouped_folds(d, "source", 5), "text")
    return spark.createDataFrame(features.logistic_cv(ready, "features", "quality"), "fold int, accuracy double")


# ---------------------------------------------------------------- DOM


@query()
def dom_nodes(spark, sf):
    return dom.nodes(table(spark, sf, "pages")).select("page_id", "node_id", "parent_id", "depth", "tag", "path", F.length("text").alias("n_text"))


@query()
def dom_segments(spark, sf):
    return dom.segments(table(spark, sf, "pages"))


def _grams_sql(key: str, where: str) -> str:
    """N-gram ranks of each key, in DuckDB."""
    return f"""SELECT {key}, g, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, g) - 1 AS r FROM (
  SELECT {key}, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))))) AS g FROM (
    SELECT {key}, ' ' || w || ' ' AS w FROM (SELECT {key}, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' ')) AS w FROM documents WHERE {where}) WHERE w <> '')) WHERE g <> ' ' GROUP BY {key}, g QUALIFY r < 300"""


@query(f"""WITH m AS ({_grams_sql("lang", "lang IS NOT NULL")}), d AS ({_grams_sql("doc_id", "length(text) >= 64")}),
n AS (SELECT doc_id, lang, sum(300 - abs(d.r - m.r)) AS gain FROM d JOIN m USING (g) GROUP BY ALL), b AS (SELECT doc_id, arg_max(lang, (gain, lang)) AS language FROM n GROUP BY 1)
SELECT doc_id, language FROM documents LEFT JOIN b USING (doc_id)""")
def detected_language(spark, sf):
    """Profiles of all labelled documents, and the language of each document of 64 characters and more."""
    docs = table(spark, sf, "documents")
    return languages.detect(docs, "doc_id", "text", languages.fit(docs, "text", "lang"))


@query()
def path_steps(spark, sf):
    """Parents of the second item's links in navigation lists: //nav//li[2]/a[@href]/.."""
    steps = [layout.Step("descendant", "nav"), layout.Step("descendant", "li", (2,)), layout.Step("child", "a", (layout.has("href"),)), layout.Step("parent")]
    nodes = Scratch(spark, "steps").save(dom.nodes(table(spark, sf, "pages"), ("own_text", "said", "before", "after", "text")), "nodes")
    return layout.follow(nodes, steps).select("page_id", "node_id", "path")


@query()
def tree_distances(spark, sf):
    """Each link of a page and the next one, by their distance in the tree."""
    nodes = Scratch(spark, "distances").save(dom.nodes(table(spark, sf, "pages"), ("end_id", "depth", "path", "attrs", "own_text", "said", "text")), "nodes")
    links = nodes.filter("tag = 'a'").select("page_id", F.col("node_id").alias("a"), F.lead("node_id").over(Window.partitionBy("page_id").orderBy("node_id")).alias("b")).filter("b IS NOT NULL")
    return layout.tree_distance(links, layout.chains(nodes)).select("page_id", "a", "b", "distance")


def laid_out(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of all pages with rectangles: a column of blocks in document order, as wide as their depth leaves and as high as their
    text asks for. The tables have no rendered layout."""
    nodes = dom.nodes(table(spark, sf, "pages"), ("said", "before", "after"))
    rows = F.ceil(F.length("text") / 80) + 1
    width = F.greatest(F.lit(1200.0) - 40 * F.col("depth"), F.lit(1.0))
    return nodes.withColumn("shown", dom.shown(F.col("tag"), F.col("attrs"))).withColumn("left", F.pmod("node_id", F.lit(3)) * 60.0 + 20 * F.col("depth")).withColumn("top", 24.0 * F.col("node_id")).withColumn("width", width).withColumn("height", 20.0 * rows).drop("text")


@query()
def layout_segments(spark, sf):
    nodes = Scratch(spark, "layout").save(laid_out(spark, sf), "nodes")
    return layout.block_segments(nodes, 1200.0 * 800).select("page_id", "node_id", "tag", "path")


@query()
def similarity_segments(spark, sf):
    nodes = Scratch(spark, "segments").save(laid_out(spark, sf), "nodes")
    return layout.similarity_segments(nodes, dom.content_vectors(table(spark, sf, "pages"))).select("page_id", "node_id", "tag", "path")


def styled(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of all pages with styles: the tables have none, so ads and articles stand above the page by their depth."""
    n = dom.nodes(table(spark, sf, "pages"), ("own_text", "said", "before", "after"))
    above = F.coalesce(F.element_at("attrs", "class") == "ad", F.lit(False)) | (F.col("tag") == "div")
    z = F.when(above, F.col("depth") + F.pmod("node_id", F.lit(3)))
    return n.select("*", dom.shown(F.col("tag"), F.col("attrs")).alias("shown"), above.alias("positioned"), z.alias("z"), F.lit(300.0).alias("width"), (F.length("text") + 100.0).alias("height"), F.lit(True).alias("centred")).drop("text", "attrs")


@query()
def popup_containers(spark, sf):
    nodes = Scratch(spark, "popups").save(styled(spark, sf), "nodes")
    return popups.popup_containers(nodes).select("page_id", "node_id", "path", "z")


@query()
def trigger_lists(spark, sf):
    """Lists that an article or one of its siblings holds or is."""
    nodes = dom.nodes(table(spark, sf, "pages")).select("page_id", "path", "tag")
    return dom.trigger_lists(nodes.filter("tag = 'article'"), nodes.filter("tag IN ('ul', 'ol')"))


@query()
def without_nested(spark, sf):
    """Blocks that hold no other block."""
    nodes = dom.nodes(table(spark, sf, "pages"), ("parent_id", "end_id", "depth", "attrs", "own_text", "said", "before", "after", "text"))
    blocks = Scratch(spark, "nested").save(nodes.filter(F.col("tag").isin(*sorted(dom.SEGMENT_BLOCKS))).select("page_id", "node_id", "path"), "blocks")
    return dom.without_nested(blocks)


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages) SELECT page_id, href FROM a WHERE href <> '' GROUP BY ALL""")
def dom_links(spark, sf):
    return dom.links(table(spark, sf, "pages")).select("page_id", "href")


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages), u AS (SELECT DISTINCT page_id, href FROM a WHERE href <> '')
SELECT page_id, href, 5 * regexp_matches(href, '(?i)th|re')::INT / 21.0::DOUBLE AS score FROM u""")
def button_regex_score(spark, sf):
    none = F.lit(None).cast("string")
    return dom.links(table(spark, sf, "pages")).select("page_id", "href", scoring.pattern_score("th|re", none, F.col("href"), none, none, none).alias("score"))


#: Events stand for the candidate buttons of a page (the user): what a button says goes by the event's number.
SAYS = ("Add to Cart", "View my bag", "Proceed to checkout", "Remove", "Buy it now", "3 items in your basket", "Search", "pay-securely-now")


def candidate_buttons(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("nth", F.pmod("event_id", F.lit(len(SAYS))).cast("int"))
    says, none = F.element_at(F.array(*map(F.lit, SAYS)), F.col("nth") + 1), F.lit(None).cast("string")
    return e.select(
        "user_id", "event_id", says.alias("text"), none.alias("target"), none.alias("source"), F.concat(F.lit("class="), "event_type").alias("attributes"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, "shopping-cart").alias("parent"), F.col("value").alias("area"), F.from_json("props", "k long")["k"].alias("color_dist"), (F.pmod("event_id", F.lit(3)) == 0).alias("in_header"),
    )


def button_sql(kind: str) -> str:
    weights, least, patterns = scoring.BUTTONS[kind]
    says = "[" + ", ".join(f"'{x}'" for x in SAYS) + "]"
    has = lambda c, p: f"coalesce(regexp_matches({c}, '(?i){p}'), false)::INT"
    regexes = ", ".join(f"(5 * {has('text', p)} + 3 * {has('attributes', p)} + 3 * {has('parent', p)}) / 21.0::DOUBLE AS regex_{k}" for k, p in enumerate(patterns, 1))
    scaled = " + ".join(f"coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0) * {x}" for c, x in weights.items())
    return f"""WITH c AS (SELECT user_id, event_id, {says}[event_id % {len(SAYS)} + 1] AS text, 'class=' || event_type AS attributes, CASE WHEN event_id % 5 = 0 THEN 'shopping-cart' END AS parent,
  value AS area, -value AS less_area, (props::JSON ->> 'k')::DOUBLE AS color_dist, (event_id % 3 = 0)::INT::DOUBLE AS in_header FROM events),
f AS (SELECT *, {regexes} FROM c), s AS (SELECT user_id, event_id, round(0.0 + {scaled}, 9) AS score FROM f WINDOW w AS (PARTITION BY user_id)),
k AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS next_score FROM s WINDOW o AS (PARTITION BY user_id ORDER BY score DESC, event_id))
SELECT user_id, event_id, score, rank::INT AS rank, next_score, rank = 1 AND score > {least} AS chosen FROM k"""


def _buttons(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    found = scoring.button_candidates(candidate_buttons(spark, sf), kind, "user_id", "event_id")
    return found.select("user_id", "event_id", "score", "rank", "next_score", "chosen")


@query(button_sql("add_to_cart"))
def add_to_cart_candidates(spark, sf):
    return _buttons(spark, sf, "add_to_cart")


@query(button_sql("cart"))
def cart_candidates(spark, sf):
    return _buttons(spark, sf, "cart")


@query(button_sql("checkout"))
def checkout_candidates(spark, sf):
    return _buttons(spark, sf, "checkout")


@query()
def link_filter(spark, sf):
    found = dom.links(table(spark, sf, "pages")).join(table(spark, sf, "pages").select("page_id", "url"), "page_id")
    full = urls.resolved(F.col("href"), F.col("url"))
    bad = F.lower("text").isin("login", "register", "sign in") | F.lower("title").isin("login", "register", "sign in") | F.col("href").rlike("[.](jpg|jpeg|pdf|png)")
    return found.withColumn("link", full).filter(F.col("link").isNotNull() & ~bad & (F.rtrim("link", F.lit("/")) != F.rtrim("url", F.lit("/")))).select("page_id", "link")


# ---------------------------------------------------------------- shapes and formats


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, coalesce(nullif(event_type, 'error'), 'None') AS category FROM events")
def nested_json_explode(spark, sf):
    wrapped = table(spark, sf, "events").select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct("event_id", "props", F.nullif("event_type", F.lit("error")).alias("category"))).alias("entries"))).alias("pages"))).alias("doc"))
    schema = "pages array<struct<entries: array<struct<event_id: long, props: string, category: string>>>>"
    e = wrapped.select(F.explode(F.from_json("doc", schema)["pages"]).alias("p")).select(F.explode("p.entries").alias("e"))
    return e.select("e.event_id", F.from_json("e.props", "k long")["k"].alias("k"), F.coalesce("e.category", F.lit("None")).alias("category"))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / d, 6) AS quantity_std, round((l_extendedprice - lo) / (hi - lo), 6) AS price_scaled FROM lineitem, s""")
def stddev_standardise(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    j = li.crossJoin(F.broadcast(s))  # one row of statistics
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") - F.col("m")) / F.col("d"), 6).alias("quantity_std"), F.round((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("price_scaled"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, strftime(ts, '%b %d %H:%M:%S') AS pretty, date_trunc('second', ts)::TIMESTAMP AS second FROM events""")
def timestamp_format(spark, sf):
    stamp = F.date_format("ts", "yyyyMMdd-HHmmss")
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp"), F.date_format(F.to_timestamp(stamp, "yyyyMMdd-HHmmss"), "MMM dd HH:mm:ss").alias("pretty"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"))


# ---------------------------------------------------------------- further shapes


@query("SELECT o_orderkey, c_name FROM (SELECT o_orderkey, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS name FROM orders) o JOIN customer c ON o.name = c.c_name")
def crc_lookup_join(spark, sf):
    key = lambda c: F.crc32(F.encode(c, "utf-8"))
    o = table(spark, sf, "orders").select("o_orderkey", F.format_string("Customer#%09d", "o_custkey").alias("name")).withColumn("sum", key(F.col("name")))
    c = table(spark, sf, "customer").select("c_name", key(F.col("c_name")).alias("sum"))
    return o.join(c, "sum").filter("name = c_name").select("o_orderkey", "c_name")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 600")
def group_size_cap(spark, sf):
    return rel.with_group_size(table(spark, sf, "lineitem").select("l_suppkey"), ["l_suppkey"]).filter("group_size <= 600").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT conv_id, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2)::BIGINT AS pair, role, turn FROM conversations")
def tuple_chunks(spark, sf):
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf, "conversations").select("conv_id", F.floor(at / 2).cast("long").alias("pair"), "role", "turn")


@query("SELECT source, doc_id, dense_rank() OVER (PARTITION BY source ORDER BY n_chars DESC)::INT AS page, count(*) OVER (PARTITION BY source) AS pages FROM documents")
def dense_labels(spark, sf):
    w = Window.partitionBy("source")
    return table(spark, sf, "documents").select("source", "doc_id", F.dense_rank().over(w.orderBy(F.desc("n_chars"))).alias("page"), F.count("*").over(w).alias("pages"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type IN ('click', 'error')) WHERE nth = 1")
def last_mark(spark, sf):
    marks = table(spark, sf, "events").filter(F.col("event_type").isin("click", "error"))
    return rel.keep_last(marks, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer) WHERE nth > least(greatest(100, 0), 1000) AND nth <= 120")
def offset_page(spark, sf):
    # a page of a report: the first 120 rows by key, of which the last 20
    first = table(spark, sf, "customer").orderBy("c_custkey").limit(120)
    return first.withColumn("nth", F.row_number().over(Window.orderBy("c_custkey"))).filter("nth > 100").select("c_custkey", "c_name")


@query("SELECT page_id, contains(lower(html), 'erth') OR contains(lower(html), 'zzz') AS has_piece, (len(list_intersect(regexp_split_to_array(lower(html), '\\s+'), ['the', 'und'])) > 0) AS has_token FROM pages")
def word_filters(spark, sf):
    return table(spark, sf, "pages").select("page_id", measures.has_any(F.col("html"), ["erth", "zzz"]).alias("has_piece"), measures.has_token(F.col("html"), ["the", "und"]).alias("has_token"))


@query("WITH c AS (SELECT page_id, (length(lower(html)) - length(replace(lower(html), 'add to cart', ''))) / 11 AS cart, (length(lower(html)) - length(replace(lower(html), 'add to bag', ''))) / 10 AS bag FROM pages) SELECT page_id, (cart BETWEEN 1 AND 2 AND bag = 0) OR (bag BETWEEN 1 AND 2 AND cart = 0) AS product FROM c")
def product_page_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", scoring.is_product_page(F.col("html")).alias("product"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH p AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.') AS l FROM pages)
SELECT page_id, CASE WHEN len(l) > 1 THEN array_to_string(l[-2:], '.') END AS domain, l[-1] AS suffix FROM p""")
def site_suffix(spark, sf):
    """From URLs whose scheme was taken off and is put back; the hosts of the tables have suffixes of one label."""
    host = urls.hostname(urls.with_scheme(F.regexp_replace("url", "^[a-z]+://", "")))
    return table(spark, sf, "pages").select("page_id", urls.registrable_domain(host).alias("domain"), urls.public_suffix(host).alias("suffix"))


#: Rules in the notation of suffix lists, for the hosts of the tables.
SUFFIX_RULES = ("com", "net", "org", "*.net", "!example.net", "example.com", "de", "co.uk")


@query(f"""WITH rules AS (SELECT unnest({list(SUFFIX_RULES)}) AS rule),
h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages), l AS (SELECT host, string_split(host, '.') AS l FROM h),
e AS (SELECT host, l, k, array_to_string(l[-k:], '.') AS ending, '*.' || array_to_string(l[-k + 1:], '.') AS wild FROM l, range(1, 20) t(k) WHERE k <= len(l)),
f AS (SELECT host, max(k) FILTER (rule = ending OR (k > 1 AND rule = wild)) AS n, max(k) FILTER (rule = '!' || ending) - 1 AS x FROM e LEFT JOIN rules ON rule = ending OR rule = wild OR rule = '!' || ending GROUP BY host),
s AS (SELECT host, coalesce(x, n, 1) AS k FROM f)
SELECT page_id, array_to_string(l[-s.k:], '.') AS suffix, CASE WHEN len(l) > s.k THEN array_to_string(l[-s.k - 1:], '.') END AS domain
FROM pages JOIN l ON l.host = lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) JOIN s ON s.host = l.host""")
def suffix_rules(spark, sf):
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    pages = table(spark, sf, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"))
    return suffixes.with_suffix(pages, "host", rules).select("page_id", "suffix", "domain")


@query("SELECT conv_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 6) AS minutes FROM (SELECT user_id AS conv_id, ts FROM events) GROUP BY 1")
def elapsed_minutes(spark, sf):
    spans = table(spark, sf, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return spans.select("conv_id", F.round(series.elapsed_minutes(F.col("first"), F.col("last")), 6).alias("minutes"))


@query("SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS words FROM benchmark")
def deep_flatten(spark, sf):
    nested = F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, " "), lambda w: F.array(w)))
    return table(spark, sf, "benchmark").select("item_id", lists.deep_flatten(nested, 2).alias("words"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT item_id, list_resize(w, (len(w) + 2) // 3 * 3, '-') AS w FROM w)
SELECT item_id, list_transform(range(len(w) // 3), lambda k: array_to_string(w[k * 3 + 1 : k * 3 + 3], ' ')) AS triples FROM p""")
def filled_tuples(spark, sf):
    triples = lists.tuples(F.split("text", " "), 3, F.lit("-"))
    return table(spark, sf, "benchmark").select("item_id", F.transform(triples, lambda t: F.array_join(t, " ")).alias("triples"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), u AS (SELECT item_id, unnest(range(len(w))) AS k, unnest(w) AS x FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5('0|' || k || '|' || x), k) AS nth FROM u) SELECT item_id, string_agg(x, ' ' ORDER BY nth) AS chosen FROM r WHERE nth <= 4 GROUP BY item_id""")
def random_subarrays(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(lists.random_subarray(F.split("text", " "), 4), " ").alias("chosen"))


@query("""SELECT doc_id, length(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')) AS n_escaped,
  md5(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')) AS digest FROM documents""")
def escaped_text(spark, sf):
    c = text.escaped(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n_escaped"), F.md5(c).alias("digest"))


@query()
def text_normalise_stems(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalised(F.col("text"), STOP, stem=True).alias("normal"))


@query()
def text_tokens(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.tokens(c, STOP).alias("tokens"), text.ascii_tokens(c).alias("ascii_tokens"))


@query()
def content_vectors(spark, sf):
    return dom.content_vectors(table(spark, sf, "pages"))


@query()
def similar_blocks(spark, sf):
    pages = table(spark, sf, "pages")
    nodes = Scratch(spark, "similar").save(dom.nodes(pages, ("depth", "own_text", "said", "before", "after", "text")), "nodes")
    return dom.similar_blocks(nodes, dom.content_vectors(pages)).select("page_id", "node_id", "path")


@query("""SELECT user_id, event_id, z FROM (SELECT user_id, event_id, z, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, event_id) AS nth
  FROM (SELECT user_id, event_id, (props::JSON ->> 'k')::BIGINT AS z FROM events) WHERE z > 0) WHERE nth = 1""")
def popup_style(spark, sf):
    """Event properties in place of styles: the one of largest k by user."""
    e = table(spark, sf, "events").withColumn("z", F.from_json("props", "k long")["k"])
    return dom.popup_container(e, "user_id", "z", "event_id").select("user_id", "event_id", "z")


@query()
def word_vector_means(spark, sf):
    from pyspark.ml.functions import vector_to_array

    found = features.word_vectors(table(spark, sf, "documents").select("doc_id", "text"), "text", 16)
    return found.select("doc_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("mean"))
