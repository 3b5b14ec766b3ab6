"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into longest
matches against an automaton: from a phrase's start the automaton is walked as long as it can, and the
next phrase begins where it stops. The language whose phrases are fewest, for the letters parsed and for
how long matches with its training text are by chance, wins: phrases cost ln(training size) each.

Texts are lower-cased, and runs of anything but letters become one space. Parsing is in blocks of BLOCK
letters, each begun afresh (which adds less than one phrase a block, in every language alike), so that texts
of any length are walked side by side: one step moves every block of a batch, in every language, by one
letter with a table look-up. All blocks of a text count.

Training takes whole texts: of each language at most ROWS documents of at most TRAIN_CHARS characters, those
of least hash of doc_id and text, as far as the language's share of LETTERS goes (all have the same; the first document
always counts); of more than LANGUAGES labels the most frequent ones are learned. A language whose labelled texts are
all longer is learned from pieces of TRAIN_CHARS characters of its shortest text, as many, of least hash. So the
driver gets at most 2 * LANGUAGES * ROWS such texts, however often rows or ids repeat, and at most LETTERS letters. It builds
one automaton after the other and keeps each as a packed table of some 20 bytes a letter, which is what workers get.

Defined results: `und`, score 0, for a null text or one without letters, and for all if no labelled
document may be learned from; a row without doc_id isn't held out; languages are compared in order of name,
ties go to the first; rows that repeat a doc_id are predicted each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bound_batches, table
from . import worker

ROWS, TRAIN_CHARS, LANGUAGES = 20, 8000, 256
#: Letters that all languages are learned from; 25 languages have ROWS full texts each, more have fewer.
LETTERS = 4_000_000
BLOCK = 2048
#: Clean text costs about half of what its letters do, letters at random nearly twice as much.
FOREIGN, SHORT = 1.25, 24
HELD_OUT = 2
UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def cleaned(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def automaton(sequence: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: the edges of each state. State 1 is the start, 0 is none."""
    following: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in sequence:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


class Packed:
    """Edges of many states in one table, the rows of the states laid over one another: the edge of a state
    by a letter is at base[state] + letter, if that place is the state's own."""

    def __init__(self, edges: list[dict[int, int]], letters: int):
        total = sum(map(len, edges))
        used = bytearray(2 * total + 64 * letters)
        base = [letters] * len(edges)
        at_of, owner_of, next_of = array("i"), array("i"), array("i")
        low = 2 * letters
        for state in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
            row = sorted(edges[state])
            if not row:
                break
            at, tries = used.find(0, low), 0
            more = [c - row[0] for c in row[1:]]
            while more and any([used[at + d] for d in more]):
                at, tries = used.find(0, at + 1), tries + 1
            b = at - row[0]
            if tries > 64:  # this stretch is nearly full
                low = at - 32
            elif len(row) == 1:
                low = at
            base[state] = b
            for c in row:
                used[b + c] = 1
                at_of.append(b + c)
                owner_of.append(state)
                next_of.append(edges[state][c])
        at, owner, to = (np.array(x, np.int32) for x in (at_of, owner_of, next_of))
        places = int(at.max(initial=0)) + 2 * letters
        self.base = np.array(base, np.int32)
        self.owner, self.next = np.full(places, -1, np.int32), np.zeros(places, np.int32)
        self.owner[at], self.next[at] = owner, to

    @classmethod
    def side_by_side(cls, parts: Iterable[Packed]) -> tuple[Packed, list[int]]:
        """One table of several, made one after the other, and how far the states of each have moved."""
        bases, owners, nexts, moved, states, places = [], [], [], [], 0, 0
        for part in parts:
            own = part.owner >= 0
            bases.append(part.base + np.int32(places))
            owners.append(np.where(own, part.owner + np.int32(states), np.int32(-1)))
            nexts.append(np.where(own, part.next + np.int32(states), np.int32(0)))
            moved.append(states)
            states, places = states + len(part.base), places + len(part.owner)
        whole, none = cls.__new__(cls), np.zeros(0, np.int32)
        whole.base, whole.owner, whole.next = (np.concatenate([none, *x]) for x in (bases, owners, nexts))
        return whole, moved

    def step(self, states: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after a letter; 0 where there is no edge."""
        at = self.base[states] + letter
        return np.where(self.owner[at] == states, self.next[at], 0)


class Model:
    """Automata of several languages; made on the driver, sent to the workers."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        # 0 is a letter unknown to training, which no automaton has
        known = sorted({ch for t in texts.values() for ch in t})
        self.points = np.array([ord(ch) for ch in known], np.int64)
        code = {ch: 1 + i for i, ch in enumerate(known)}
        self.packed, moved = Packed.side_by_side(Packed(automaton([code[ch] for ch in texts[name]]), len(known) + 1) for name in self.names)
        self.starts = np.array(moved, np.int32) + np.int32(1)
        self.cost = np.log([max(len(texts[n]), 2) for n in self.names])
        #: Nats that a letter costs if letters are spelled out.
        self.letter = math.log(max(len(known), 2))

    def codes(self) -> np.ndarray:
        """A letter's code by code point."""
        out = np.zeros(0x110000, np.int32)
        out[self.points] = np.arange(1, len(self.points) + 1)
        return out

    def phrases(self, texts: list[str], codes: np.ndarray | None = None) -> np.ndarray:
        """For each cleaned text and language, how many phrases the parse takes."""
        n = len(self.names)
        out = np.zeros((len(texts), n), np.int64)
        codes = self.codes() if codes is None else codes
        encoded = [codes[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in texts]
        sizes = np.array([len(e) for e in encoded], np.int64)
        if not sizes.sum():
            return out
        whole = np.concatenate([*encoded, np.zeros(BLOCK, np.int32)])
        firsts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = firsts[owner] + nth * BLOCK
        lengths = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-lengths, kind="stable")  # a step moves the blocks that are that long: a prefix
        begin, lengths, owner = begin[order], lengths[order], owner[order]
        active = np.searchsorted(-lengths, -np.arange(BLOCK), "left")  # blocks longer than step k
        start = self.starts[:, None]
        state = np.repeat(start, len(begin), axis=1)
        counts = np.ones((n, len(begin)), np.int32)
        for k in range(int(lengths[0])):
            m = int(active[k])
            letter = whole[begin[:m] + k]
            here = state[:, :m]
            to = self.packed.step(here, letter)
            failed = to == 0
            if failed.any():
                # the phrase ends before this letter, which begins the next one (alone, if it is unknown)
                row, col = np.nonzero(failed)
                first = self.starts[row]
                again = self.packed.step(first, letter[col])
                unknown = again == 0
                counts[row, col] += (here[row, col] != first).astype(np.int32) + unknown
                to[row, col] = np.where(unknown, first, again)
            state[:, :m] = to
        for j in range(n):
            out[:, j] = np.bincount(owner, counts[j], minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None], codes: np.ndarray | None = None) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether it is in a language at all: false without letters, and
        where, in texts of SHORT letters and more, even the best language's phrases cost more than FOREIGN times
        what spelling out every letter does."""
        clean = [cleaned(t) if t else "" for t in texts]
        known = [i for i, c in enumerate(clean) if c]
        names, scores, told = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if not known or not self.names:
            return names, scores, told
        sizes = np.array([len(clean[i]) for i in known])
        phrases = self.phrases([clean[i] for i in known], codes)
        # nats a letter under each language; the shares of 1 / rate, sharpened by the letters seen
        rates = phrases * self.cost / sizes[:, None]
        best = rates.argmin(axis=1)
        weight = np.exp(-np.minimum((rates - rates.min(axis=1, keepdims=True)) * sizes[:, None], 700))
        for row, i in enumerate(known):
            names[i] = self.names[best[row]]
            scores[i] = float(weight[row, best[row]] / weight[row].sum())
            told[i] = bool(sizes[row] < SHORT or phrases[row, best[row]] * self.cost[best[row]] <= FOREIGN * sizes[row] * self.letter)
        return names, scores, told


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (-1 for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(4)), F.lit(-1))


def training_texts(docs: DataFrame, rows: int = ROWS, chars: int = TRAIN_CHARS, languages: int = LANGUAGES, letters: int = LETTERS) -> dict[str, str]:
    """Cleaned training text by language, from labelled documents outside the held-out fold: at most `rows`
    whole texts of at most `chars` characters, or pieces of that size of the shortest text of a language that has longer ones alone,
    for each of at most `languages` languages, and at most `letters` characters in all (`chars` a language at least)."""
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    short = F.length("text") <= chars
    usable = docs.select("lang", "text", mark.alias("mark")).filter((fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # a language's share of marks that leaves about 3 * rows of them; with fewer, all. Rows that repeat are one.
    sums = usable.groupBy("lang").agg(F.count_if(short).alias("n"), F.approx_count_distinct(F.when(short, F.col("mark"))).alias("marks"), F.count("*").alias("n_all"))
    found = sums.orderBy(F.desc("n"), F.desc("n_all"), "lang").limit(languages).collect()
    if not found:
        return {}
    share = {r.lang: 1.0 if r.marks < 4 * rows else 3.0 * rows / r.marks for r in found if r.n}
    most = F.create_map(*(F.lit(x) for pair in share.items() for x in pair)) if share else F.lit(None).cast("map<string, double>")
    near = usable.filter(short & (F.col("mark") <= F.element_at(most, F.col("lang")))).groupBy("lang", "mark").agg(F.min("text").alias("text"))
    if longer := [r.lang for r in found if not r.n]:
        least = usable.filter(F.col("lang").isin(longer)).groupBy("lang").agg(F.min_by("text", F.struct(F.length("text"), "mark")).alias("text"))
        pieces = least.select("lang", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))).alias("nth", "text"))
        near = near.unionByName(pieces.filter(F.col("text").rlike(r"\p{L}")).select("lang", (F.shiftrightunsigned(F.xxhash64("nth", "text"), 11) / float(1 << 53)).alias("mark"), "text"))
    in_order = Window.partitionBy("lang").orderBy("mark")
    chosen = near.withColumn("nth", F.row_number().over(in_order)).filter(F.col("nth") <= rows)
    within = F.sum(F.length("text")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= max(chars, letters // len(found))
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.withColumn("within", within).filter(F.col("within") | (F.col("nth") == 1)).select("lang", "mark", "text").collect(), key=lambda r: (r.lang, r.mark)):
        if c := cleaned(r.text):
            out.setdefault(r.lang, []).append(c)
    return {lang: " ".join(parts) for lang, parts in out.items()}


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score and told (`Model.predict`) of each row, from its text alone."""
    model = Model(texts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("language_id")
        codes = model.codes()
        for batch in batches:
            names, scores, told = model.predict(batch.column(1).to_pylist(), codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(told, pa.bool_())], ["doc_id", "lang_pred", "score", "told"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, told boolean")


def accepted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are in one of the languages learned from it (`told`): texts without letters and
    texts that no language parses better than letter by letter (times FOREIGN) go; very short ones have the benefit of the
    doubt. With nothing to learn from, letters alone decide. Same columns; rows that repeat share a fate."""
    bound_batches(spark, 4 << 20)
    model = Model(training_texts(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("language_id")
        codes = model.codes()
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("text")).to_pylist()
            told = model.predict(rows, codes)[2] if model.names else [bool(t and cleaned(t)) for t in rows]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark, 4 << 20)
    docs = table(spark, sf_dir, "documents")
    return identify(docs, training_texts(docs)).withColumn("held_out", fold() == HELD_OUT).select("doc_id", "held_out", "lang_pred", "score")
