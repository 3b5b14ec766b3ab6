import json

from pyspark.sql import functions as F

from millrace.sources import readers, sinks
from millrace.streaming import jobs


def write(path, content):
    path.write_text(content)
    return str(path)


def test_text_layouts(spark, tmp_path):
    assert [tuple(r) for r in readers.whitespace_separated(spark, write(tmp_path / "c", " -1   20\n3 4\n\n"), ["cluster", "count"]).collect()] == [(-1, 20), (3, 4)]
    assert readers.matrix(spark, write(tmp_path / "m", "1 2.5\n-3 4e1\n")).collect()[1].row == [-3.0, 40.0]
    assert [r.url for r in readers.url_lists(spark, write(tmp_path / "u", "rank,url\n1,a.com\n2,https://b.com\n")).collect()] == ["http://a.com", "https://b.com"]
    assert [r.n for r in readers.integers(spark, write(tmp_path / "i", "5\nx\n 7\n")).collect()] == [5, 7]
    rows = readers.csv(spark, write(tmp_path / "s.csv", "url,global_rank,country_rank,reach_per_million,page_views_per_million,page_views_per_user\n a.com ,1,2,3.5,4,5\n"), readers.TOP_SITES, trim=True).collect()
    assert tuple(rows[0]) == ("a.com", 1, 2, 3.5, 4.0, 5.0)


def test_json_har_xml_and_small_files(spark, tmp_path):
    har = {"log": {"pages": [{"entries": [{"request": {"url": "http://a/b?c"}, "response": {"content": {"mimeType": "t", "text": "body"}}}, {"request": {"url": "http://x"}}]}]}}
    (tmp_path / "h").mkdir()
    write(tmp_path / "h" / "1.har", json.dumps(har))
    write(tmp_path / "h" / "2.har", "{broken")
    assert [tuple(r) for r in readers.har_contents(spark, str(tmp_path / "h")).collect()] == [("a/b", "t", "body")]
    (tmp_path / "f").mkdir()
    write(tmp_path / "f" / "1", "http://a\n<b>\n  x</b>\n")
    assert tuple(readers.small_files(spark, str(tmp_path / "f")).first()) == ("http://a", "<b> x</b>")
    xml = write(tmp_path / "x.xml", "<r><Site><Url>a</Url><Rank>3</Rank></Site><Site><Url>b</Url></Site></r>")
    assert [tuple(r) for r in readers.xml_records(spark, xml, "Site", "Url string, Rank int").collect()] == [("a", 3), ("b", None)]
    tree = json.dumps([{"title": "T", "path": "Top", "sites_count": 5, "categories": [{"title": "S", "path": "Top/S", "sites_count": 41, "categories": [{"title": "U", "path": "Top/S/U", "sites_count": 2}]}]}])
    cats = readers.category_rows(spark.createDataFrame([(tree,)], "j string"), "j")
    assert sorted(map(tuple, cats.collect())) == [("Top", 5), ("Top/S", 41), ("Top/S/U", 2)]
    assert [r.start for r in readers.listing_offsets(cats.filter("path = 'Top/S'"), "sites_count").collect()] == [1, 21]
    ends = readers.literal_table(spark, [{"name": "a", "url": "u"}, {"name": "b", "url": "v", "method": "GET"}], {"method": "POST"}, "name string, method string, url string")
    assert [r.method for r in ends.orderBy("name").collect()] == ["POST", "GET"]


def test_log_events(spark, tmp_path):
    log = write(tmp_path / "l", "2018-01-01 10:00 - main - start Visit Id: 7\nnoise\n2018-01-01 10:01 - main - stop Visit Id: 7\n")
    rows = readers.log_events(spark, log, [("start", "^([^a-zA-Z]*) - .*start"), ("end", "^([^a-zA-Z]*) - .*stop")]).collect()
    assert [tuple(r) for r in rows] == [("2018-01-01 10:00", "start", 7), ("2018-01-01 10:01", "end", 7)]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, v string")
    sinks.csv(df, f"{tmp_path}/csv")
    assert readers.csv(spark, f"{tmp_path}/csv", "k int, v string").count() == 3
    sinks.tsv(df.coalesce(1), f"{tmp_path}/tsv", ["v", "k"], ["k"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/tsv").collect()][0] == "a\t1"
    sinks.json_lines(df, f"{tmp_path}/json")
    assert readers.json_lines(spark, f"{tmp_path}/json", "k int, v string").count() == 3
    sinks.json_dict(df, "k", "v", f"{tmp_path}/dict")
    assert json.loads(spark.read.text(f"{tmp_path}/dict").first().value) == {"1": "a", "2": "b", "3": "c"}
    sinks.parquet(df, f"{tmp_path}/pq", ["v"])
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 3
    for _ in range(2):
        sinks.append_lines(df, "k", f"{tmp_path}/ids")
    assert readers.integers(spark, f"{tmp_path}/ids").count() == 6
    sinks.chunks(df, "k", 2, f"{tmp_path}/chunks")
    assert spark.read.schema("k int, v string, chunk int").csv(f"{tmp_path}/chunks").groupBy("chunk").count().orderBy("chunk").collect()[0]["count"] == 2


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    batch = spark.read.parquet(src)
    once = jobs.drained(jobs.first_seen(stream(), ["user_id", "event_type"], "ts", "3650 days"), "first_seen", f"{tmp_path}/c1")
    assert once.count() == batch.select("user_id", "event_type").distinct().count()
    counts = jobs.drained(jobs.windowed_counts(stream(), "ts", "event_type", "1 day", "0 seconds"), "windowed", f"{tmp_path}/c2", "append")
    want = {(r.d, r.event_type): r["count"] for r in batch.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count().collect()}
    got = {(r.start, r.event_type): r.n for r in counts.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert jobs.drained(jobs.sessions(stream(), "ts", "user_id"), "sessions", f"{tmp_path}/c3").count() > 0
    (tmp_path / "poll").mkdir()
    write(tmp_path / "poll" / "1.tsv", "API-Response:\tshop\t{}\th\nother\tx\ty\tz\n")
    assert jobs.drained(jobs.poll_log(spark, str(tmp_path / "poll")), "poll", f"{tmp_path}/c4").count() == 1
