"""Personal data: base patterns, and information-theoretic sanitisation of what gives them away.

The e-mail addresses, IP addresses, card numbers and phone numbers of a text are its protected entities. A term of the
text may reveal an entity even where that is masked, if the corpus shows that the two go together. With
N documents, df(t) and df(c) of them with term t and entity c, and co(t, c) with t among the CONTEXT words
on either side of c, a term discloses the share PMI(t, c) / IC(c) = 1 + ln(co / df(t)) / ln(N / df(c)) of the
entity's information: 1 if the term only occurs beside the entity, 0 if the two are independent. Terms that disclose
REMOVE or more are removed, and those of GENERALISE or more are generalised to the class of their letters, wherever
they occur in a document that holds the entity, if at least SUPPORT different texts show the pair. Other
documents stay as they are.

Two passes over the texts: the first finds entities and the terms around them (so many pairs as context words),
the second counts documents for the terms that SUPPORT leaves. Counts are summed in the task before they
move; the table of those terms is broadcast only after a check of its size.

Terms are runs of 3 to 64 letters outside base spans, lower-cased. Base patterns are matched in linear time:
a pattern can only begin at the first digit of a run, at a plus sign, or at the first letter before an at sign.

Defined results: a null text is empty and has no spans; repeated rows count each, and copies of one text support a pair
once; a doc_id may be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, free_name, table
from . import worker
from .rows import text_sha

KINDS = ("email", "ip", "card", "phone")
REMOVED, GENERALISED = "remove", "generalise"
CONTEXT, SUPPORT = 10, 2
GENERALISE, REMOVE = 0.6, 0.8
#: Most terms, or flagged pairs, that are broadcast; beyond it they are joined.
BROADCAST_ROWS = 200_000
#: Counts that a task holds before it passes them on, and letters of a text that are looked at together.
HELD, SLICE = 200_000, 1 << 20

DIGITS = re.compile(r"[0-9][0-9]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIALLED = re.compile(r"[\x20().0-9-]*")
LETTERS = re.compile(r"[^\W\d_]{3,}")
NOT_LETTERS = re.compile(r"[\W\d_]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def ips(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    out, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[a:b].lstrip("0") or "0" for a, b in four]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return out


def luhn(digits: str) -> bool:
    values = list(map(int, reversed(digits)))
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    out, i = [], 0
    while i < len(runs):
        start, end = runs[i]
        n = end - start
        while i + 1 < len(runs) and runs[i + 1][0] - end == 1 and text[end] in " -":
            i += 1
            end = runs[i][1]
            n += end - runs[i][0]
        if 16 <= n <= 19 and luhn(text[start:end].replace(" ", "").replace("-", "")):
            out.append(("card", start, end))
        i += 1
    return out


def phones(text: str) -> list[Span]:
    out, plus = [], text.find("+")
    while plus >= 0:
        after = plus + 1
        if text[after : after + 1] in tuple("0123456789"):
            dialled = DIALLED.match(text, after + 1).group().rstrip(" ().-")
            if len(dialled) >= 2:
                after += 1 + len(dialled)
                if 8 <= 1 + sum(c.isdigit() for c in dialled) <= 15:
                    out.append(("phone", plus, after))
        plus = text.find("+", after)
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans (kind, start, end) of a text in code points, by kind, then start."""
    runs = [m.span() for m in DIGITS.finditer(text)]
    return emails(text) + ips(text, runs) + cards(text, runs) + phones(text)


def entity(text: str, span: Span) -> str:
    """What a base span stands for: its kind and its value without case, spaces and marks."""
    kind, start, end = span
    value = text[start:end]
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else ''.join(c for c in value if c.isdigit())}"


def slices(text: str) -> Iterator[tuple[int, int]]:
    """Bounds that cut no word, about SLICE apart."""
    start = 0
    while len(text) - start > SLICE:
        m = NOT_LETTERS.search(text, start + SLICE)
        end = m.end() if m else len(text)
        yield start, end
        start = end
    yield start, len(text)


def words(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Bounds of the terms of a text: words outside its spans."""
    covered = sorted((a, b) for _, a, b in spans)
    out, k, end = [], 0, 0
    for m in LETTERS.finditer(text):
        a, b = m.span()
        while k < len(covered) and covered[k][0] < b:
            end = max(end, covered[k][1])
            k += 1
        if end <= a and b - a <= 64:
            out.append((a, b))
    return out


def vocabulary(text: str, spans: list[Span]) -> set[str]:
    """The terms of a text."""
    if spans:
        return {text[a:b].lower() for a, b in words(text, spans)}
    seen: set[str] = set()
    for start, end in slices(text):
        seen.update(LETTERS.findall(text, start, end))
    return {w.lower() for w in seen if len(w) <= 64}


def context(text: str, spans: list[Span]) -> tuple[set[tuple[str, str]], dict[str, list[tuple[int, int]]]]:
    """The pairs (term, entity) of terms around an entity, and all places of those terms in the text."""
    terms, pairs = words(text, spans), set()
    for span in spans:
        i, j, name = bisect_left(terms, (span[1], 0)), bisect_left(terms, (span[2], 0)), entity(text, span)
        pairs.update((text[a:b].lower(), name) for a, b in terms[max(0, i - CONTEXT) : i] + terms[j : j + CONTEXT])
    near, places = {t for t, _ in pairs}, {}
    for a, b in terms:
        if (t := text[a:b].lower()) in near:
            places.setdefault(t, []).append((a, b))
    return pairs, places


PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
FIELDS = {
    "row": pa.int64(), "doc_id": pa.int64(), "sha": pa.string(), "n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base": pa.string(),
    "entities": pa.list_(pa.string()), "pairs": pa.list_(pa.struct([("term", pa.string()), ("entity", pa.string())])), "terms": pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(PLACE))])),
}
SCAN = "row long, doc_id long, sha string, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, pairs array<struct<term:string,entity:string>>, terms array<struct<term:string,at:array<struct<start:int,end:int>>>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.begin("pii")
    for batch in batches:
        out: dict[str, list] = {name: [] for name in list(FIELDS)[2:]}
        for text in batch.column(2):
            text = text.as_py() or ""
            spans = base_spans(text)
            pairs, places = context(text, spans) if spans else ((), {})
            n = Counter(k for k, _, _ in spans)
            values = (
                hashlib.sha256(text.encode()).hexdigest(), *(n[k] for k in KINDS), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), sorted({entity(text, s) for s in spans}),
                [{"term": t, "entity": c} for t, c in sorted(pairs)], [{"term": t, "at": [{"start": a, "end": b} for a, b in at]} for t, at in sorted(places.items())],
            )
            for column, value in zip(out.values(), values):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, FIELDS[k]) for k, v in out.items())], list(FIELDS))


def _counted(wanted: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each term, summed within the task."""
        worker.begin("pii")
        held: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                terms = vocabulary(text, base_spans(text))
                held.update(terms & wanted.value if wanted else terms)
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: its base spans, entities, the pairs around them and those terms' places."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned, SCAN)


def disclosure(n: float, co: Column, of_term: Column, of_entity: Column) -> Column:
    """Share of an entity's information that a term gives: PMI / IC."""
    return 1 + F.log(co / of_term) / F.log(n / of_entity)


def disclosing(scratch: Scratch, docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """term, entity, co, of_term, of_entity, share and action of the pairs of enough support that disclose enough."""
    spark, n = scratch.spark, scanned.count()
    # equal texts become one row before they move, so copies are no task's burden
    shown = scanned.select("sha", F.explode("pairs").alias("p")).groupBy("p.term", "p.entity", "sha").agg(F.count("*").alias("n"))
    pairs = scratch.save(shown.groupBy("term", "entity").agg(F.sum("n").alias("co"), F.count("*").alias("texts")).filter(F.col("texts") >= support), "pairs")
    needed = scratch.save(pairs.select("term").distinct(), "needed")
    terms = None
    if needed.count() <= broadcast_rows:
        terms = spark.sparkContext.broadcast(frozenset(r.term for r in needed.collect()))
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counted(terms), "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term"))
    of_term = scratch.save(counted.join(needed, "term", "left_semi"), "terms")
    of_entity = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity")).filter(F.col("of_entity") < n)
    share = disclosure(float(n), F.col("co"), F.col("of_term"), F.col("of_entity"))
    joined = pairs.join(of_entity, "entity").join(of_term, "term").withColumn("share", share).filter(F.col("share") >= GENERALISE)
    return scratch.save(joined.withColumn("action", F.when(F.col("share") >= REMOVE, REMOVED).otherwise(GENERALISED)), "disclosing")


def find_spans(spark: SparkSession, docs: DataFrame, support: int = SUPPORT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each row of `docs`: doc_id, sha, n_email, n_ip, n_card, n_phone, base (its spans, kind:start:end) and
    method (the spans that sanitisation adds: array of structs start, end, kind)."""
    scratch = Scratch(spark, "pii")
    scanned = scratch.save(scan(docs), "scan")
    flags = disclosing(scratch, docs, scanned, support, broadcast_rows).select("term", "entity", "action")
    if flags.count() <= broadcast_rows:
        flags = F.broadcast(flags)
    keep = ["doc_id", "sha", "n_email", "n_ip", "n_card", "n_phone", "base"]
    # a term that two entities flag is removed if one of them asks for it
    hits = scanned.select("row", F.explode("pairs").alias("p")).select("row", "p.*").join(flags, ["term", "entity"]).groupBy("row", "term").agg(F.max("action").alias("action"))
    by_row = scratch.save(hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions")), "hits")
    with_terms = scanned.filter(F.size("terms") > 0).join(by_row, "row", "left")
    placed = F.flatten(F.transform(F.filter("terms", lambda t: F.map_contains_key("actions", t["term"])), lambda t: F.transform(t["at"], lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.element_at("actions", t["term"]).alias("kind")))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    found = with_terms.select(*keep, F.when(F.col("actions").isNull(), none).otherwise(F.array_sort(placed)).alias("method"))
    return found.unionByName(scanned.filter(F.size("terms") == 0).select(*keep, none.alias("method")))


MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", REMOVED: ""}


def masked(text: str, spans: list[Span]) -> str:
    """The text with its spans masked: base ones by their kind, removed terms by nothing, generalised ones by the class
    of their letters. Of overlapping spans, all go; the first gives the mask."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            word = text[a:b]
            out += [text[last:a], MASKS[kind] if kind in MASKS else "[ACRONYM]" if word.isupper() else "[NAME]" if word[0].isupper() else "[WORD]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.begin("pii")
    for batch in batches:
        texts = []
        for text, base, method in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (base or "").split(",") if s)] + [(s["kind"], s["start"], s["end"]) for s in method or []]
            texts.append(masked(text, spans) if spans else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], batch.schema.names[:2])


def sanitised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with all spans of its texts masked; its columns, its rows and texts without spans as they are."""
    spans = find_spans(spark, docs).filter("base <> ''").select(F.col("doc_id").alias("__of_id"), F.col("sha").alias("__of_sha"), F.col("base").alias("__base"), F.col("method").alias("__method")).dropDuplicates(["__of_id", "__of_sha"])
    spans = Scratch(spark, "pii-spans").save(spans, "spans")
    row = free_name(docs, "__row")
    joined = docs.select(F.struct(*docs.columns).alias(row), F.col("doc_id").cast("long").alias(f"{row}_id"), text_sha().alias(f"{row}_sha"))
    joined = joined.join(spans, F.col(f"{row}_id").eqNullSafe(F.col("__of_id")) & (F.col(f"{row}_sha") == F.col("__of_sha")), "left")
    kind = joined.schema[row].dataType.simpleString()
    out = joined.select(row, F.col(f"{row}.text").cast("string").alias("__text"), "__base", "__method").mapInArrow(_masked, f"{row} {kind}, __text string")
    return out.select(*(F.col("__text").alias("text") if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark, table(spark, sf_dir, "documents"))
    # kinds in the contract's order, then those of the method; each by start
    of = lambda kind: F.transform(F.filter("method", lambda s: s["kind"] == kind), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    spans = F.concat_ws(",", F.filter(F.array("base"), lambda b: b != ""), of(GENERALISED), of(REMOVED))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
