"""Readers: every layout is declared, none inferred; all paths go through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_VISITS = "visit_id long, crawl_id long, site_url string"
HTTP_REQUESTS = "visit_id long, url string, method string, post_body string, top_level_url string"
TOP_SITES = "url string, global_rank int, country_rank int, reach_per_million double, page_views_per_million double, page_views_per_user double"
HAR = "log struct<pages: array<struct<entries: array<struct<request: struct<url: string>, response: struct<content: struct<mimeType: string, text: string>>>>>>, entries: array<struct<request: struct<url: string>, response: struct<content: struct<mimeType: string, text: string>>>>>"
CATEGORY = "title string, path string, categories_count int, sites_count int"
#: Levels of a category tree below its root.
LEVELS = 3


def _tree(levels: int) -> str:
    fields = ", ".join(f.strip().replace(" ", ": ") for f in CATEGORY.split(","))
    return f"array<struct<{fields}{f', categories: {_tree(levels - 1)}' if levels > 1 else ''}>>"


CATEGORY_TREE = _tree(LEVELS)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, trim: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("escape", '"').option("multiLine", True).csv(path)


def whitespace_separated(spark: SparkSession, path: str, names: list[str], kind: str = "int") -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*(F.get(parts, F.lit(i)).try_cast(kind).alias(n) for i, n in enumerate(names)))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """One array of doubles a line."""
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("row"))


def url_lists(spark: SparkSession, path: str) -> DataFrame:
    """URLs of headerless comma lists: the last cell, without a header line, with a scheme."""
    cell = F.element_at(F.split(F.trim("value"), ","), -1)
    url = F.when(cell.startswith("http"), cell).otherwise(F.concat(F.lit("http://"), cell))
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.lower(cell).isin("url", "domain", "website")).select(url.alias("url"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_dict(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """name and value of each entry of JSON objects, one object a file."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("name", "value"))


def integers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("n")).filter("n IS NOT NULL")


def har_contents(spark: SparkSession, path: str) -> DataFrame:
    """base_url and content of responses in HAR files; broken files and missing fields are passed over."""
    from ..functions.urls import base_url

    logs = spark.read.schema(HAR).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    of_pages = logs.select(F.explode("log.pages").alias("p")).select(F.explode("p.entries").alias("e"))
    direct = logs.select(F.explode("log.entries").alias("e"))
    entries = of_pages.unionByName(direct)
    return entries.select(base_url(F.col("e.request.url")).alias("base_url"), F.col("e.response.content.mimeType").alias("mime_type"), F.col("e.response.content.text").alias("content")).filter("content IS NOT NULL")


def small_files(spark: SparkSession, path: str) -> DataFrame:
    """url (a file's first line) and element (the rest, white space squeezed)."""
    return spark.read.text(path, wholetext=True).select(F.substring_index("value", "\n", 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", " ")).alias("element"))


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def category_rows(trees: DataFrame, column: str) -> DataFrame:
    """path and sites_count of every category of a nested tree (JSON text), LEVELS levels deep."""
    level = trees.select(F.explode(F.from_json(column, CATEGORY_TREE)).alias("c"))
    out = level.select("c.path", "c.sites_count")
    for _ in range(LEVELS - 1):
        level = level.select(F.explode("c.categories").alias("c"))
        out = out.unionByName(level.select("c.path", "c.sites_count"))
    return out


def literal_table(spark: SparkSession, rows: list[dict], defaults: dict, schema: str) -> DataFrame:
    """A configuration table of dicts with optional keys."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n, defaults.get(n)) for n in names) for r in rows], schema)


def listing_offsets(df: DataFrame, count: str, page: int = 20) -> DataFrame:
    """One row for each page start 1, 1 + page, ... below a row's count."""
    return df.filter(F.col(count) > 1).withColumn("start", F.explode(F.sequence(F.lit(1), (F.col(count) - 1).cast("int"), F.lit(page))))


def log_events(spark: SparkSession, path: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """time, phase and visit_id of log lines: the first pattern that fits names the phase; group 1 of it
    is the time; the visit is the number after its name."""
    from ..operators.relational import first_match

    lines = spark.read.text(path)
    time = F.coalesce(*(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)) for _, p in patterns))
    return lines.select(time.alias("time"), first_match(F.col("value"), patterns).alias("phase"), F.regexp_extract("value", r"Visit Id: ([0-9]+)", 1).try_cast("long").alias("visit_id")).filter("phase IS NOT NULL")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
