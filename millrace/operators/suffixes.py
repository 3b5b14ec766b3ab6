"""Public suffixes by a table of rules that the caller gives: `com`, `co.uk`, `*.ck`, `!www.ck`.

A rule of k labels fits a host whose last k labels it names; `*` stands for any one label, at the front only. Of
the rules that fit, an exception decides (its suffix is the rule without its first label), else the longest; if
none fits, the last label is the suffix. Each distinct host meets the rules once, by its endings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import IP
from ..session import Scratch

#: Most rules and hosts that are broadcast; beyond it they are joined.
BROADCAST_ROWS = 200_000


def rule_table(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """ending and kind (0 plain, 1 wildcard, 2 exception) of each rule; empty lines and // comments are none."""
    r = F.lower(F.trim(F.col(rule)))
    kind = F.when(r.startswith("!"), 2).when(r.startswith("*."), 1).otherwise(0)
    return rules.filter(r.isNotNull() & (r != "") & ~r.startswith("//")).select(F.regexp_replace(r, r"^(!|\*\.)", "").alias("ending"), kind.alias("kind")).distinct()


def suffix_of(hosts: DataFrame, rules: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """host, suffix and domain of distinct hosts (column `host`, lower-case). The domain has one label more than the suffix; it is null where
    the host is a suffix itself, and an address in numbers is its own domain, without suffix."""
    labels = F.split("host", r"\.")
    named = hosts.filter("host IS NOT NULL AND host <> ''").select("host").distinct().withColumn("labels", labels)
    ending = F.array_join(F.slice("labels", -F.col("k"), F.col("k")), ".")
    each = named.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels")))).withColumn("ending", ending)
    table = rule_table(rules)
    small = table.limit(broadcast_rows + 1).count() <= broadcast_rows
    fits = each.join(F.broadcast(table) if small else table, "ending")
    size = F.when(F.col("kind") == 2, F.col("k") - 1).when(F.col("kind") == 1, F.col("k") + 1).otherwise(F.col("k"))
    fits = fits.withColumn("size", size).filter(F.col("size").between(1, F.size("labels")))
    best = fits.groupBy("host").agg(F.max(F.struct((F.col("kind") == 2).alias("exception"), F.col("size"))).alias("m")).select(F.col("host").alias("of"), "m.size")
    sized = named.join(best, F.col("host") == F.col("of"), "left").withColumn("size", F.coalesce("size", F.lit(1)))
    last = lambda n: F.array_join(F.slice("labels", -n, n), ".")
    address = F.col("host").rlike(IP)
    domain = F.when(address, F.col("host")).when(F.size("labels") > F.col("size"), last(F.col("size") + 1))
    return sized.select("host", F.when(~address, last(F.col("size"))).alias("suffix"), domain.alias("domain"))


def with_suffix(df: DataFrame, host: str, rules: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with suffix and domain of its host column (null for a null or empty host)."""
    found = Scratch(df.sparkSession, "suffixes").save(suffix_of(df.select(F.col(host).alias("host")), rules, broadcast_rows), "hosts")
    found = found.withColumnRenamed("host", "_host")
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = F.broadcast(found)
    return df.join(found, F.col(host) == F.col("_host"), "left").drop("_host")
