"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its weight's share of the whole mix, at most `most` times its own
words; what is above goes to the others by weight. Within a source the expected copies of a document grow
with its length: they are in proportion to 2^(pull * k) for documents of 2^k words and more (k whole), at most
`most`, at the level that makes the expected words the target. The whole part of them are certain copies; the
fraction is the inclusion probability p of one more. Documents are ranked by their random odds over their
inclusion odds, (u/(1-u)) / (p/(1-p)), u being a hash of doc_id and text, and the first are taken as long as
their words don't pass what is missing: an unequal-probability sample of fixed size in words. From the document
at the edge on, the one whose size comes nearest to the gap that is left is taken too, if that is nearer than
leaving it open.

The edge is found by two rounds of 256 bins of the order, so a source that holds a third of all rows is
summed by many tasks, and only a 65,536th of it is sorted. The table of sources, a row each, is ordered in
one task, since their weights go by their order; a source's classes of length are some sixty rows.

Defined results: a null or empty text has size 0 and is never drawn; null is a source of its own, last in
order; a source without words has target 0; rows that repeat a doc_id are drawn each, rows that repeat doc_id
and text are interchangeable; an empty table gives an empty mix; other columns are ignored. Reruns agree,
since nothing depends on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, table
from .rows import take_rows, text_sha

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 42
#: How inclusion grows with length: 0 for alike, 0.5 for the root of the size.
PULL = 0.5
BINS = 256


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digest: bool = False) -> DataFrame:
    """row (a number of its own), doc_id, source, size (words) and mark (hash of id and text) of each row;
    with `digest` also the sha of its text."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    columns = [F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), mark.alias("mark")]
    return docs.select(*columns, *([text_sha(text_col).alias("sha")] if digest else []))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target. One row a source: the windows see sources, not documents.

    Sources whose limit is small for their weight stop there first, so in the order of limit by weight
    the common level for the rest is known; the first source that this level doesn't reach ends it."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weighed = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(most))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    whole, rest = Window.partitionBy(), by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * float(share) - (F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))) / F.sum("weight").over(rest)
    found = weighed.withColumn("level", level).withColumn("free", F.col("level") <= F.col("limit") / F.col("weight"))
    # Levels rise up to the first free source and fall after it, so the largest free one is the common one;
    # without any, every source stops at its limit.
    levels = found.withColumn("common", F.max(F.when(F.col("free"), F.col("level"))).over(whole))
    return levels.select("source", "source_size", F.coalesce(F.least("limit", F.col("weight") * F.col("common")), "limit").alias("target"))


def shares(sized: DataFrame, goals: DataFrame, most: float = MOST, pull: float = PULL) -> DataFrame:
    """of (source), class (of length), source_size, target, whole (certain copies) and p (inclusion
    probability of one more) of each class: expected copies c * 2^(pull * class), at most `most`.

    The longest classes reach `most` first. With the first j of them there, c is known from the rest; the
    least j at which the next class stays below is the right one."""
    words = sized.filter("size > 0").groupBy("source", F.floor(F.log2("size")).cast("int").alias("class")).agg(F.sum("size").alias("words"))
    named = words.withColumnRenamed("source", "of").join(goals, F.col("of").eqNullSafe(F.col("source"))).drop("source").withColumn("pull", F.pow(F.lit(2.0), F.col("class") * pull))
    order = Window.partitionBy("of").orderBy(F.desc("class"))
    above = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("pull")).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = named.withColumn("level", (F.col("target") - above * float(most)) / rest)
    # the first class that the level leaves below `most` gives the common one; levels of later ones don't count
    free = F.when(F.col("level") * F.col("pull") <= float(most), F.struct((-F.col("class")).alias("nth"), "level"))
    common = F.min(free).over(Window.partitionBy("of"))["level"]
    copies = F.round(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(common * F.col("pull"), F.lit(float(most))))), 9)
    return level.withColumn("copies", copies).select("of", "class", "source_size", "target", F.floor("copies").cast("long").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"), "words")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, pull: float = PULL, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digest: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, p, copies and taken (copies * size) of each row, and with
    `digest` the sha of its text."""
    scratch = Scratch(spark, "mix")
    sized = scratch.save(sizes(docs, id_col, text_col, source_col, digest), "sizes")
    goals = scratch.save(targets(sized, weights, share, most), "targets")
    classes = shares(sized, goals, most, pull)
    needs = classes.groupBy("of").agg((F.sum(F.col("p") * F.col("words"))).alias("need"))
    ways = scratch.save(classes.withColumnRenamed("of", "s").join(needs, F.col("s").eqNullSafe(F.col("of"))).select("s", "class", "whole", "p", "need"), "ways")
    u = (F.shiftrightunsigned(F.xxhash64("mark", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rank = odds / (1 + odds)  # the order of the odds, between 0 and 1
    in_class = F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.log2("size")).cast("int") == F.col("class"))
    classed = sized.join(ways, in_class, "left").drop("s", "class")
    placed = classed.join(goals.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    drawn = scratch.save(placed.withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("rank", F.when(F.col("p") > 0, rank)), "drawn")
    fine = F.least(F.floor(F.col("rank") * BINS * BINS), F.lit(BINS * BINS - 1)).cast("int")
    drawn = drawn.withColumn("b1", F.floor(fine / BINS).cast("int")).withColumn("b2", F.pmod(fine, F.lit(BINS)).cast("int"))

    def edge(rows: DataFrame, bin_: str, need: str) -> DataFrame:
        """of, edge and room: the bin in which a source's running words pass `need`, and what is missing before it."""
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(bin_))
        sums = rows.groupBy("source", bin_).agg(F.sum("size").alias("words"), F.first(need).alias("n")).withColumn("upto", upto)
        return sums.filter("upto > n AND upto - words <= n").select(F.col("source").alias("of"), F.col(bin_).alias("edge"), (F.col("n") - F.col("upto") + F.col("words")).alias("room"))

    open_ = drawn.filter("rank IS NOT NULL")
    first = scratch.save(edge(open_, "b1", "need"), "edge1").select("of", F.col("edge").alias("e1"), F.col("room").alias("room1"))
    in_first = open_.join(first, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    second = scratch.save(edge(in_first.filter("b1 = e1"), "b2", "room1"), "edge2").select("of", F.col("edge").alias("e2"), F.col("room").alias("room2"))
    edged = in_first.join(second, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "mark", "row")
    near = edged.filter("b1 = e1 AND b2 = e2").withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = scratch.save(near.withColumn("hit", F.col("upto") <= F.col("room2")).select("row", "source", "size", "room2", "hit"), "near")
    gaps = near.groupBy("source").agg((F.first("room2") - F.coalesce(F.sum(F.when(F.col("hit"), F.col("size"))), F.lit(0))).alias("gap")).withColumnRenamed("source", "of")
    hits = near.filter("hit").select("row")
    # one more document, of those from the edge on, that closes the gap
    beyond = edged.filter("b1 > e1 OR (b1 = e1 AND b2 >= e2)").join(near.filter("hit").select(F.col("row")), "row", "left_anti").join(gaps, F.col("source").eqNullSafe(F.col("of")))
    closing = beyond.filter("abs(gap - size) < abs(gap)").groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "doc_id", "mark", "row")).alias("best")).select(F.col("best.row").alias("row"))
    picked = scratch.save(hits.unionByName(closing), "picked").withColumn("picked", F.lit(1))
    edges = first.select("of", "e1").join(second.select(F.col("of").alias("of2"), "e2"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    out = drawn.join(edges, F.col("source").eqNullSafe(F.col("of")), "left").join(picked, "row", "left")
    one_more = F.coalesce(F.col("picked"), F.when((F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2"))), 1), F.lit(0))
    named = ["doc_id", "source", "size", "source_size", "target", F.coalesce("p", F.lit(0.0)).alias("p"), "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return out.withColumn("copies", F.col("whole") + one_more).select(*named, *(["sha"] if digest else []))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is drawn; the columns of `docs`."""
    drawn = mix(spark, docs, digest=True)
    copies = drawn.groupBy("doc_id", "sha").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).filter("copies > 0")
    return take_rows(Scratch(spark, "mixed"), docs, copies)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
