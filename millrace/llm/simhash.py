"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the link radius; two fingerprints at most
`radius` apart share a variant. Rows are shuffled on the variant, so no pairs of documents are made:
fingerprints are deduplicated first, and a variant can hold only the fingerprints of its own small ball
(65 for radius 2). Each colliding pair is verified by counting differing bits. Components come from
alternating large-star and small-star rounds over the links, held in tables of the shared folder.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text with fewer
words than a shingle has one shingle, the whole sequence; rows with one doc_id each count; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import worker
from .rows import keep_rows, text_sha

SEED = 42
BLOCK = 1 << 16


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of n words, space-joined, in blocks of bounded size."""
    if not words:
        return
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < n:
        yield np.array([hash64(join(words), seed)], np.uint64)
        return
    total = len(words) - n + 1
    for at in range(0, total, BLOCK):
        part = words[at : min(total, at + BLOCK) + n - 1]
        grams = zip(*(part[i:] for i in range(n)))
        yield np.fromiter([hash64(join(g), seed) for g in grams], np.uint64)


def fingerprint(text: str | None, n: int, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingles' hashes, repeats included."""
    ones, total = np.zeros(64, np.int64), 0
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the six ASCII white-space bytes
    for block in shingle_hashes((text or "").encode().lower().split(), n, seed):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("simhash")
        for batch in batches:
            seen: dict = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in seen:
                    seen[text] = fingerprint(text, n, seed)
                out.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "id long, fp long")


def _ball(fp: str, half: int) -> str:
    """SQL for the array of all longs within `half` bits of `fp` (half 0 or 1)."""
    if half == 0:
        return f"array({fp})"
    return f"transform(sequence(-1, 63), k -> CASE WHEN k < 0 THEN {fp} ELSE {fp} ^ shiftleft(1L, k) END)"


def _members(v: str, bits: str, n: str, least: str) -> str:
    """SQL for the members above `least` of the ball of centre `v`, whose `n` members differ from it in `bits`."""
    others = f"transform(filter(sequence(0, 63), k -> getbit({bits}, k) = 1), k -> {v} ^ shiftleft(1L, k))"
    return f"filter(concat(CASE WHEN {n} > bit_count({bits}) THEN array({v}) ELSE array() END, {others}), x -> x > {least})"


#: Fingerprints a task takes when it emits their variants.
NODES_A_TASK = 1 << 14


def ball_links(scratch: Scratch, nodes: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints of `nodes` (fp, distinct) within `radius` bits; with
    `keys`, columns of `nodes`, those of equal keys.

    Fingerprints that share a variant lie within radius of each other, so linking the least of them to
    each other one keeps every class whole; links between two members of a ball that both have a link
    to its least one aren't listed. That asks for an even radius; above 2 a fingerprint would have 2081 variants.

    A member of a ball is its centre or differs from it in one bit, so those bits put together, and the number of
    members, name them all: nothing is listed but members."""
    if radius not in (0, 2):
        raise ValueError("radius 0 or 2")
    half = radius // 2
    spread = nodes.select(*keys, "fp").repartition(1 + nodes.count() // NODES_A_TASK, "fp")
    variants = spread.select(*keys, "fp", F.explode(F.expr(_ball("fp", half))).alias("v"))
    # most variants are met once, so they move as they are rather than summed up first
    bits = F.bit_or(F.col("fp").bitwiseXOR(F.col("v"))).alias("bits")
    balls = variants.repartition(*keys, "v").groupBy(*keys, "v").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), bits).filter("n > 1")
    found = scratch.save(balls, "balls")
    # a ball of two: its ends; of more: the least with each other one
    pairs = found.filter("n = 2").select(*keys, "a", "b")
    more = found.filter("n > 2").select(*keys, "a", F.explode(F.expr(_members("v", "bits", "n", "a"))).alias("b"))
    return pairs.unionByName(more).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(scratch: Scratch, links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of `links` (a, b: distinct links): root is the component's least node.

    Large-star links a node's larger neighbours to its least one; small-star links its smaller
    neighbours and itself to it. Both keep components, and rounds of the two end in stars."""
    edges, step = scratch.save(links.select("a", "b").filter("a <> b"), f"{name}0"), 0
    last = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark[0] == 0 or mark == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        last = mark
        # large-star
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small-star: u is the larger end of each link now
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(small_least, "b").select("m", F.explode(F.array("a", "b")).alias("x")).filter("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        step += 1
        new = scratch.save(star, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        edges = new


def near_components(spark: SparkSession, docs: DataFrame, n: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest doc_id reachable over links)."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(docs, n, id_col, text_col), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    stars = components(scratch, ball_links(scratch, nodes, radius))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


#: Fingerprints of its words that a text gets when near copies are sought by similarity.
TABLES = 8
#: Texts whose shingles are counted to tell common shingles from rare ones, and the most shingles named common.
SAMPLE_TEXTS, COMMON = 1 << 12, 1 << 16
#: Classes of shingles whose parities are compared: sets that differ in d shingles differ in at most d parities.
SIGNATURE = 256


def word_prints(words: list[bytes], tables: int = TABLES) -> list[int]:
    """`tables` independent SimHash fingerprints of a text's words, a word weighing the root of its count.
    A near copy's words change little, so some of its fingerprints come close. Without words, zeros."""
    counts = Counter(words)
    if not counts:
        return [0] * tables
    steps = np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    base = np.fromiter([xxhash.xxh64_intdigest(w, SEED) for w in counts], np.uint64)
    weights = np.floor(np.sqrt(np.fromiter(counts.values(), np.float64)) * 256)
    total, sums = weights.sum(), np.zeros(64 * tables)
    for at in range(0, len(base), 4096):
        mixed = base[at : at + 4096, None] + steps
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((mixed ^ mixed >> np.uint64(31)).view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        sums += weights[at : at + 4096] @ bits.astype(np.float64)  # whole numbers: exact in any order
    return np.packbits(2 * sums > total, bitorder="little").view(np.int64).tolist()


def similarity(one: str | None, two: str | None, n: int) -> float:
    """Jaccard similarity of the texts' sets of n-word shingles, A-Z lower-cased; of two without words, 1."""
    a, b = (_shingle_set(t, n) for t in (one, two))
    return len(a & b) / len(a | b) if a or b else 1.0


def _shingle_set(text: str | None, n: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _shingle_keys(words: list[bytes], n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles, as signed longs."""
    blocks = list(shingle_hashes(words, n))
    return np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(0, np.int64)


def common_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a sample hold, and in how many: at most COMMON come
    to the driver. They only order the shingles of a prefix; every order gives the same links."""
    share = max(1, docs.count() // SAMPLE_TEXTS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("near_dedup")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_keys((text or "").encode().lower().split(), n))], ["token"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counts = sample.mapInArrow(scan, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens, held = (top.column(k).to_numpy() for k in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], held[order]


def described(docs: DataFrame, n: int, least: float, common: tuple[np.ndarray, np.ndarray], tables: int = TABLES) -> DataFrame:
    """For each row: doc_id, sha of its text, the fps of its words, the size of its shingle set, the set's parities
    in SIGNATURE classes of its hashes (sig), and its prefix (tokens): so many shingles, rare ones first, that two sets of a similarity of at least `least` have
    one of them in common; and the place (end) where the prefix ends in that order."""
    known, held = common

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("near_dedup")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                words = raw.lower().split()
                keys = _shingle_keys(words, n)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                rank = np.where(known[at] == keys, held[at], 0) if len(known) else np.zeros(len(keys), np.int64)
                take = len(keys) - math.ceil(least * len(keys) - 1e-9) + 1 if len(keys) else 0
                order = np.lexsort((keys, rank))[:take]
                end = {"rank": int(rank[order[-1]]), "key": int(keys[order[-1]])} if take else None
                odd = np.bincount(keys & SIGNATURE - 1, minlength=SIGNATURE) & 1
                sig = np.packbits(odd.astype(np.uint8)).view(np.int64)
                for column, value in zip(out, (hashlib.sha256(raw).hexdigest(), word_prints(words, tables), len(keys), sig, end, keys[order])):
                    column.append(value)
            types = (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.struct([("rank", pa.int64()), ("key", pa.int64())]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "sha", "fps", "size", "sig", "end", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, sha string, fps array<long>, size long, sig array<long>, end struct<rank: long, key: long>, tokens array<long>")


#: Tables whose variants are shuffled at once.
AT_ONCE = 4


def ball_pairs(scratch: Scratch, sets: DataFrame, tables: int = TABLES, radius: int = 2) -> DataFrame:
    """Some pairs (a, b) of ids, a < b, that collide in a table (t). In a ball each fingerprint is paired with
    the least one, and of one fingerprint each id with the least: as many pairs as rows, however large a
    group is."""
    found = None
    for first in range(0, tables, AT_ONCE):
        own = sets.select("id", F.posexplode(F.slice("fps", first + 1, AT_ONCE)).alias("t", "fp"))
        nodes = scratch.save(own.groupBy("t", "fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), f"nodes{first}")
        links = ball_links(scratch, nodes, radius, ("t",))
        one, two = nodes.select("t", F.col("fp").alias("a"), F.col("rep").alias("x")), nodes.select("t", F.col("fp").alias("b"), F.col("rep").alias("y"))
        across = links.join(one, ["t", "a"]).join(two, ["t", "b"]).select("x", "y")
        inside = own.join(nodes.filter("n > 1").select("t", "fp", "rep"), ["t", "fp"]).select(F.col("rep").alias("x"), F.col("id").alias("y"))
        pairs = across.unionByName(inside).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        some = scratch.save(pairs, f"pairs{first}")
        scratch.drop(f"nodes{first}", "balls")
        found = some if found is None else found.unionByName(some)
    return found.distinct()


#: Texts to compare whose digests are broadcast, to pick them out without moving the others; of more, both sides move.
BROADCAST_ROWS = 100_000


def _alike(scratch: Scratch, pairs: DataFrame, docs: DataFrame, ids: DataFrame, n: int, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose whole texts have a similarity of at least `least`; `ids` (id, sha) names the texts."""
    needed = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(ids, "id"), "needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    rows = docs.select(text_sha().alias("sha"), F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.save(rows.join(few, "sha").groupBy("id").agg(F.first("text").alias("text")), "texts")
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("one")), texts.select(F.col("id").alias("b"), F.col("text").alias("two"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("near_dedup")
        for batch in batches:
            alike = [similarity(x, y, n) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(verify, "a long, b long")


def prefix_tokens(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """id, size, end, sig, root and tokens: the shingles of a set's prefix that several components (root) hold, the
    rarest first. A shingle of one connected group, or of one text, has nothing to compare."""
    of = sets.select("id", "size", "end", "sig", "tokens").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    tokens = of.select(F.explode("tokens").alias("token"), "id", "size", "end", "sig", "root")
    shared = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held")).filter("lo < hi").select("token", "held")
    listed = tokens.join(shared, "token").groupBy("id", "size", "end", "sig", "root").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("tokens"))
    return listed.withColumn("tokens", F.col("tokens.token"))


def _need(least: float) -> Column:
    """How many shingles of their lists two sets (sizes m and k, ends end_a and end_b) must share. The set whose
    prefix ends first has at most those and its shingles after the prefix in common with the other."""
    after = F.ceil(F.when(F.col("end_a") < F.col("end_b"), F.col("m")).otherwise(F.col("k")) * least - 1e-9) - 1
    return F.greatest(F.lit(1), F.ceil((F.col("m") + F.col("k")) * (least / (1 + least)) - 1e-6 - after))


def met_pairs(scratch: Scratch, held: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ids in different components that can reach the similarity. Where two lists of h and g
    shingles must share `need`, in one order, the first that they share is among the first h - need + 1 of the
    one and g - need + 1 of the other; rare ones come first, so that common ones seldom bring sets together.
    Sets of the similarity differ in few shingles, and so in as few parities at most."""
    rows = held.select(F.posexplode("tokens").alias("at", "token"), "id", "size", "end", "root", F.size("tokens").alias("listed"), "sig")
    one, two = rows.toDF("at_a", "token", "a", "m", "end_a", "x", "has_a", "sig_a"), rows.toDF("at_b", "token", "b", "k", "end_b", "y", "has_b", "sig_b")
    differ = sum(F.bit_count(F.get("sig_a", F.lit(i)).bitwiseXOR(F.get("sig_b", F.lit(i)))) for i in range(SIGNATURE // 64))
    alike = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & (F.least("m", "k") >= F.greatest("m", "k") * least - 1e-6)
    can = alike & (differ <= (F.col("m") + F.col("k")) * ((1 - least) / (1 + least)) + 1e-6) & (F.least(F.col("has_a") - F.col("at_a"), F.col("has_b") - F.col("at_b")) >= _need(least))
    met = one.alias("one").join(two.alias("two"), (F.col("one.token") == F.col("two.token")) & can)
    pairs = scratch.save(met.select("a", "b", _need(least).alias("need")).distinct(), "met")
    lists = held.select("id", "tokens")
    both = pairs.join(lists.toDF("a", "one"), "a").join(lists.toDF("b", "two"), "b")
    return both.filter(F.size(F.array_intersect("one", "two")) >= F.col("need")).select("a", "b")


def near_links(scratch: Scratch, sets: DataFrame, docs: DataFrame, n: int, least: float, tables: int = TABLES, radius: int = 2) -> DataFrame:
    """Verified links (a, b) that connect all `sets` of a similarity of at least `least`, none missed.

    Ball hashing first connects large groups with as many pairs as rows. An exact prefix join then compares all
    that can be alike and isn't connected yet."""
    ids = sets.select("id", "sha")
    near = scratch.save(_alike(scratch, scratch.save(ball_pairs(scratch, sets, tables, radius), "pairs"), docs, ids, n, least), "near")
    scratch.drop(*(f"pairs{t}" for t in range(0, tables, AT_ONCE)), "pairs")
    roots = scratch.save(components(scratch, near).select(F.col("node").alias("id"), "root").distinct(), "roots")
    can = scratch.save(met_pairs(scratch, scratch.save(prefix_tokens(sets, roots), "held"), least), "can")
    scratch.drop("held", "roots", "met")
    rest = scratch.save(_alike(scratch, can, docs, ids, n, least), "rest")
    scratch.drop("can", "needed", "texts")
    return near.unionByName(rest)


def near_dedup(spark: SparkSession, docs: DataFrame, n: int = 5, least: float = 0.8, tables: int = TABLES, radius: int = 2) -> DataFrame:
    """The rows of `docs` without near copies: of texts linked by a similarity of at least `least` over n-word
    shingles, the row of smallest doc_id stays. No such pair is missed (`near_links`); each is verified on the
    whole texts.

    Defined results: a null text is empty; all texts without words are copies of each other; rows without
    doc_id come after all others, and of those the one of least digest stays; of rows that repeat doc_id and
    text one stays, whichever; rows that share only their doc_id are decided each on its own text; columns as
    in `docs`; an empty table stays empty."""
    scratch = Scratch(spark, "near")
    every = scratch.save(described(docs, n, least, common_shingles(docs, n), tables), "every")
    rows = scratch.save(every.groupBy("doc_id", "sha").agg(F.count("*").alias("n")), "rows")
    # one line a distinct text; its number is fixed by being written
    distinct = every.groupBy("sha").agg(F.first("fps").alias("fps"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("end").alias("end"), F.first("tokens").alias("tokens"))
    sets = scratch.save(distinct.select(F.monotonically_increasing_id().alias("id"), "*"), "sets")
    scratch.drop("every")
    ids = sets.select("id", "sha")
    links = near_links(scratch, sets, docs, n, least, tables, radius)
    roots = components(scratch, links, "all").select(F.col("node").alias("id"), "root").distinct()
    named = scratch.save(ids.join(roots, "id", "left").select("sha", F.coalesce("root", "id").alias("root")), "named")
    scratch.drop("sets")
    first = rows.join(named, "sha").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha", "n")).alias("first"))
    return keep_rows(scratch, docs, first.select("first.doc_id", "first.sha", "first.n"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark, table(spark, sf_dir, "documents"), n=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
