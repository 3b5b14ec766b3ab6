"""Queries over stored formats: a table is written by a sink, read back by a reader, and must give what the table says; then cleaners
of text, boxes and orders that no other query shows. Written below `spark.checkpoint.dir`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures, text
from ..operators import dom, features, options
from ..operators import relational as rel
from ..session import Scratch, table
from ..sources import readers, sinks
from .catalog import LINES, lines, query

# ---------------------------------------------------------------- formats


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(spark, sf):
    """Cells are padded before they are written, and trimmed by the reader."""
    path = Scratch(spark, "csv").path("customers")
    padded = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.concat("c_mktsegment", F.lit("  ")).alias("c_mktsegment"), "c_acctbal")
    sinks.csv(padded, path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double", trim=True)


@query("SELECT o_orderkey::INT AS orderkey, o_custkey::INT AS custkey FROM orders")
def tsv_round_trip(spark, sf):
    path = Scratch(spark, "tsv").path("orders")
    sinks.tsv(table(spark, sf, "orders"), path, ["o_orderkey", "o_custkey"], ["o_custkey", "o_orderkey"])
    return readers.whitespace_separated(spark, path, ["orderkey", "custkey"])


@query("SELECT vec_id, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def matrix_round_trip(spark, sf):
    """A row of the matrix is the id, then the vector."""
    path = Scratch(spark, "matrix").path("vectors")
    wide = table(spark, sf, "embeddings").filter("embedding IS NOT NULL").select(F.concat(F.array(F.col("vec_id").cast("double")), F.transform("embedding", lambda x: x.cast("double"))).alias("row"))
    sinks.matrix(wide, "row", path)
    row = F.slice("row", 2, 1 << 30)
    return readers.matrix(spark, path).select(F.col("row")[0].cast("long").alias("vec_id"), F.size(row).alias("width"), F.round(F.aggregate(row, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS n_kept, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE)), 0), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def sparse_round_trip(spark, sf):
    """Vectors without their negative places, stored by indices and values."""
    from pyspark.ml.functions import array_to_vector

    path = Scratch(spark, "sparse").path("vectors")
    positive = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")).otherwise(0.0))
    sinks.sparse_matrix(table(spark, sf, "embeddings").filter("embedding IS NOT NULL").select("vec_id", array_to_vector(positive).alias("v")), "vec_id", "v", path)
    return spark.read.parquet(path).select(F.col("id").alias("vec_id"), F.size("indices").alias("n_kept"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT event_id, user_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_lines_round_trip(spark, sf):
    path = Scratch(spark, "json").path("events")
    sinks.json_lines(table(spark, sf, "events").select("event_id", "user_id", F.from_json("props", "k long").alias("props")), path)
    return readers.json_lines(spark, path, "event_id long, user_id long, props struct<k: long>").select("event_id", "user_id", "props.k")


@query("SELECT o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def json_report(spark, sf):
    """A report of bounded size as one JSON object, read back as rows."""
    path = Scratch(spark, "report").path("priorities")
    sinks.json_dict(table(spark, sf, "orders").filter("o_orderpriority IS NOT NULL").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", "n", path)
    return readers.json_dict(spark, path, "long").select("name", F.col("value").alias("n"))


@query("SELECT 'http://' || regexp_extract(url, '://([^/?#,]*)', 1) AS url, count(*) AS n FROM pages WHERE regexp_matches(url, '://[^/?#,]') GROUP BY 1")
def url_list_round_trip(spark, sf):
    """Headerless comma lists with the host as the last cell, and header lines among them."""
    path = Scratch(spark, "urls").path("list")
    host = F.regexp_extract("url", "://([^/?#,]*)", 1)
    pages = table(spark, sf, "pages").filter(F.col("url").rlike("://[^/?#,]"))
    sinks.append_lines(pages.select(F.concat_ws(",", "page_id", host).alias("line")), "line", path)
    sinks.append_lines(table(spark, sf, "region").select(F.lit("rank,url").alias("line")), "line", path)
    return readers.url_lists(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT o_custkey::INT AS n, 2 * count(*) AS times FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def id_lines(spark, sf):
    """Ids appended twice to a text, one a line."""
    path = Scratch(spark, "ids").path("customers")
    for _ in range(2):
        sinks.append_lines(table(spark, sf, "orders").filter("o_custkey IS NOT NULL"), "o_custkey", path)
    return readers.integers(spark, path).groupBy("n").agg(F.count("*").alias("times"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CASE event_type WHEN 'click' THEN 'action' ELSE 'end' END AS phase, user_id AS visit_id FROM events WHERE event_type IN ('click', 'error')")
def log_lines(spark, sf):
    """Events written as lines of a log; clicks and errors are the phases that the patterns know."""
    path = Scratch(spark, "log").path("lines")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - main - "), "event_type", F.lit(" Visit Id: "), F.col("user_id").cast("string"))
    sinks.append_lines(table(spark, sf, "events").select(line.alias("line")), "line", path)
    return readers.log_events(spark, path, [("action", "^([^a-zA-Z]*) - main - click"), ("end", "^([^a-zA-Z]*) - main - error")])


@query("SELECT s_suppkey::INT AS key, s_name AS name, s_nationkey::INT AS nation FROM supplier")
def xml_round_trip(spark, sf):
    path = Scratch(spark, "xml").path("suppliers")
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("nation"))
    rows.write.format("xml").option("rootTag", "Suppliers").option("rowTag", "Supplier").save(path)
    return readers.xml_records(spark, path, "Supplier", "key int, name string, nation int")


@query("""WITH c AS (SELECT r_name, n_name, c_mktsegment AS m, count(*)::INT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_name AS path, sum(n)::INT AS sites_count FROM c GROUP BY 1 UNION ALL SELECT r_name || '/' || n_name, sum(n)::INT FROM c GROUP BY 1 UNION ALL SELECT r_name || '/' || n_name || '/' || m, n FROM c""")
def category_tree(spark, sf):
    """Customers as a tree of regions, nations and segments in JSON, and the tree as rows. Groups are reduced to counts before they nest."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("int").alias("n"))
    low = counts.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = lambda title, path, n, below: F.struct(title.alias("title"), path.alias("path"), n.cast("int").alias("sites_count"), *below)
    leaf = kind(F.col("c_mktsegment"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment"), F.col("n"), [])
    mid = low.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.collect_list(leaf).alias("categories"))
    top = mid.groupBy("r_name").agg(F.sum("n").alias("n"), F.collect_list(kind(F.col("n_name"), F.concat_ws("/", "r_name", "n_name"), F.col("n"), ["categories"])).alias("categories"))
    trees = top.select(F.to_json(F.array(kind(F.col("r_name"), F.col("r_name"), F.col("n"), ["categories"]))).alias("tree"))
    return readers.category_rows(trees, "tree")


@query("""SELECT event_id, method, url FROM events JOIN (VALUES ('click', 'POST', 'https://a.example/click'), ('error', 'GET', 'https://a.example/error')) t(name, method, url) ON event_type = name""")
def literal_endpoints(spark, sf):
    """A literal table with a key left out (method: POST), joined to events."""
    ends = readers.literal_table(spark, [{"name": "click", "url": "https://a.example/click"}, {"name": "error", "url": "https://a.example/error", "method": "GET"}], {"method": "POST"}, "name string, method string, url string")
    return table(spark, sf, "events").join(F.broadcast(ends), F.col("event_type") == F.col("name")).select("event_id", "method", "url")


@query("SELECT chunk::INT AS chunk, count(*) AS n, min(o_orderkey)::BIGINT AS least, max(o_orderkey)::BIGINT AS most FROM (SELECT o_orderkey, ntile(8) OVER (ORDER BY o_orderkey) AS chunk FROM orders) GROUP BY 1")
def chunk_files(spark, sf):
    """A sorted list in eight files, read back."""
    path = Scratch(spark, "chunks").path("orders")
    sinks.chunks(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 8, path)
    return spark.read.schema("o_orderkey long, chunk int").csv(path).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


# ---------------------------------------------------------------- text


@query("""SELECT doc_id, length(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS n_stripped, md5(replace(replace(replace(text, chr(13), ''), chr(10), ''), chr(9), '')) AS unbroken,
  regexp_replace(text, '[^0-9]+', '', 'g') AS digits, md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS squeezed, length(regexp_replace(text, '[^\\x{00}-\\x{FF}]', '', 'g')) AS n_latin FROM documents""")
def text_cleaners(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(text.strip_whitespace(c)).cast("long").alias("n_stripped"), F.md5(text.without_breaks(c)).alias("unbroken"),
        text.digits_only(c).alias("digits"), F.md5(text.squeezed(c)).alias("squeezed"), F.length(text.latin1_only(c)).cast("long").alias("n_latin"),
    )


@query(f"""WITH {LINES} SELECT source, count(*) AS n FROM lines WHERE source <> 'BODY' AND regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') <> '' GROUP BY 1""")
def stripped_segments(spark, sf):
    """Segments that aren't of BODY (in this case) and not blank when all white space is stripped."""
    return lines(spark, sf).filter((F.col("source") != "BODY") & (text.strip_whitespace(F.col("line")) != "")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT page_id, left(regexp_replace(url, '[^\\p{L}\\p{N}._-]', '', 'g'), 128) AS name FROM pages")
def page_file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


# ---------------------------------------------------------------- boxes

#: A line's columns stand for two rectangles: left, top, width, height.
BOXES = (("l_partkey % 100", "l_suppkey % 100", "l_quantity", "l_linenumber * 10"), ("l_orderkey % 100", "l_linenumber * 7", "l_linenumber * 9", "l_quantity"))


def boxes_sql() -> str:
    boxes = ", ".join(f"({e})::DOUBLE AS {n}{k}" for k, box in enumerate(BOXES, 1) for n, e in zip("xywh", box))
    share = lambda a, b: f"greatest(0.0, coalesce((least({a}1 + {b}1, {a}2 + {b}2) - greatest({a}1, {a}2)) / nullif(least({b}1, {b}2), 0), 0.0))"
    meet = "(x1 < x2 + w2 AND x2 < x1 + w1 AND y1 < y2 + h2 AND y2 < y1 + h1)"
    return f"""WITH b AS (SELECT l_orderkey, l_linenumber, {boxes} FROM lineitem)
SELECT l_orderkey, l_linenumber, {meet} AS meet, round(CASE WHEN {meet} THEN 0.0 ELSE greatest({share('y', 'h')}, {share('x', 'w')}) END, 6) AS seam,
  round(sqrt(((x1 + w1 / 2) - (x2 + w2 / 2)) ** 2 + ((y1 + h1 / 2) - (y2 + h2 / 2)) ** 2), 6) AS distance, (x1 >= 0 AND y1 >= 0 AND w1 BETWEEN 5 AND 40 AND h1 BETWEEN 10 AND 60) AS in_box FROM b"""


@query(boxes_sql())
def box_measures(spark, sf):
    b = [[F.expr(e).cast("double") for e in box] for box in BOXES]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", measures.rectangles_meet(*b[0], *b[1]).alias("meet"), F.round(measures.seam_degree(*b[0], *b[1]), 6).alias("seam"),
        F.round(measures.centre_distance(*b[0], *b[1]), 6).alias("distance"), measures.in_box(*b[0], (5, 10), (40, 60)).alias("in_box"),
    )


@query("SELECT p_partkey, round(sqrt((p_partkey % 256 - p_size) ** 2 + (p_size * 5 - 200) ** 2 + (7 - p_partkey % 11) ** 2), 6) AS distance FROM part")
def colour_distances(spark, sf):
    one = F.concat(F.lit("rgb("), F.concat_ws(", ", F.pmod("p_partkey", F.lit(256)), F.col("p_size") * 5, F.lit(7)), F.lit(")"))
    two = F.concat(F.lit("rgba("), F.concat_ws(", ", F.col("p_size"), F.lit(200), F.pmod("p_partkey", F.lit(11)), F.lit("0.5")), F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", F.round(measures.colour_distance(one, two), 6).alias("distance"))


@query("""WITH e AS (SELECT event_id, (props::JSON->>'k')::BIGINT AS k, event_type, value FROM events)
SELECT event_id, (coalesce(k - 20 > 0, false) AND event_type IN ('click', 'error') AND k % 7 <> 0 AND abs(value + 50 - 200) <= 120 AND abs(k + 10 - 60) <= 36)::INT AS in_popup FROM e""")
def popup_flags(spark, sf):
    """Styles and boxes made of an event: z-index k - 20, fixed if a click and absolute if an error, hidden if k is divisible by 7."""
    k = F.from_json("props", "k long")["k"]
    position = F.when(F.col("event_type") == "click", "fixed").when(F.col("event_type") == "error", "absolute").otherwise("static")
    style = F.create_map(F.lit("z-index"), (k - 20).cast("string"), F.lit("position"), position, F.lit("display"), F.when(k % 7 == 0, "none").otherwise("block"))
    flag = measures.in_popup(style, F.col("value"), k.cast("double"), F.lit(100.0), F.lit(20.0), F.lit(400.0), F.lit(120.0))
    return table(spark, sf, "events").select("event_id", flag.alias("in_popup"))


@query("""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs'), '<(a|button|input|select|textarea|option)[ >]')) AS n FROM pages""")
def interactable_counts(spark, sf):
    n = dom.nodes(table(spark, sf, "pages"), ("parent_id", "end_id", "depth", "path", "own_text", "said", "before", "after", "text"))
    return n.groupBy("page_id").agg(F.count_if(dom.interactable(F.col("tag"), F.col("attrs"))).alias("n"))


@query()
def product_options(spark, sf):
    """Option groups of pages whose styles are derived from their nodes: the tables have none. List items and links float in rows of
    the middle of a window of 1,000; every third list is hidden."""
    n = dom.nodes(table(spark, sf, "pages"))
    small = F.col("tag").isin("li", "a", "button", "label", "div")
    styled = n.select(
        "*", ((F.pmod("node_id", F.lit(3)) > 0) | ~F.col("tag").isin("ul", "ol", "dl")).alias("shown"), F.lit(400.0).alias("left"), (F.lit(205.0) + F.pmod("node_id", F.lit(300)) * 2).alias("top"),
        F.when(small, 60.0).otherwise(900.0).alias("width"), F.when(small, 24.0).otherwise(400.0).alias("height"), small.alias("border"), F.when(F.col("tag") == "li", "inline-block").alias("display"),
        F.when(F.col("tag") == "a", "left").alias("float"), F.lit(False).alias("fixed"),
    )
    stored = Scratch(spark, "options").save(styled, "nodes")
    return options.product_options(stored, 1000.0)


# ---------------------------------------------------------------- orders and vectors


@query("SELECT l_orderkey, size, row_number() OVER (ORDER BY size DESC, l_orderkey) AS place FROM (SELECT l_orderkey, len(list(l_linenumber)) AS size FROM lineitem GROUP BY 1)")
def lists_by_length(spark, sf):
    """Lists of an order's lines, the longest first."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("members"))
    sized = lists.select("l_orderkey", F.size("members").cast("long").alias("size"), (-F.size("members")).alias("_less"))
    return rel.numbered(sized, ["_less", "l_orderkey"], "place").select("l_orderkey", "size", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5('3|' || c_custkey), c_custkey) AS place FROM customer")
def full_shuffle(spark, sf):
    """All rows in a random order that is the same in each run."""
    return rel.shuffled(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "place", seed=3).withColumn("place", F.col("place").cast("long"))


@query("SELECT vec_id, len(embedding) + 2 AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + label + vec_id % 3, 6) AS total FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL")
def appended_features(spark, sf):
    rows = table(spark, sf, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").withColumn("third", F.pmod("vec_id", F.lit(3)))
    wide = features.appended(rows, "embedding", ["label", "third"])
    return wide.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
