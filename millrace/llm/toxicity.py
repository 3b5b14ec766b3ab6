"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight for each word is shared by all ordered thresholds: P(grade >= k) = sigmoid(s - t_k), where s is
the weighted sum of the text's words and t_1 < t_2 < ... the thresholds. A text's expected severity is the
sum of these probabilities; it is called toxic if P(grade >= 1) is at least `cut`.

Features: lower-cased letter runs of the whole text and their first 4 and 5 letters, each with 1 + ln(count) up to its SATURATION-th
occurrence. The vocabulary is the words that set the grades of training texts apart (`telling`). Training takes at most
`sample` labelled texts (SAMPLE by default, the ones of least hash of id, grade and text, so reruns agree), whole;
their words are counted on the executors, and a word that no two of them share doesn't come to the driver.

Defined results: a null or wordless text has the score of no words; labels outside the grades or null are
left out; rows that repeat a doc_id, a grade and a text are one; a doc_id with several texts or grades counts
with each; without labelled rows of two grades every severity is 0
and nothing is toxic; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import worker

SAMPLE, MIN_TEXTS, SATURATION = 4000, 4, 20
Z_LEAST = 4.0
WORD = re.compile(r"[^\W\d_]+")
CUT = 0.35


PREFIXES = (4, 5)


def of_word(word: str) -> list[str]:
    """A word's features: itself, and its beginnings (for words that inflect or are put together)."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def features(words: list[str]) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in of_word(word):
            out[f] += n
    return out


GAIN = [0.0] + [1 + math.log(k) for k in range(1, SATURATION + 1)]


def gain(count: int) -> float:
    return GAIN[min(count, SATURATION)]


def telling(held: np.ndarray, texts: np.ndarray, grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Of (text, feature) entries, the features whose share of texts some threshold sets apart by at least
    Z_LEAST standard errors of the difference. Other features only add noise to the weights."""
    total, n = np.bincount(held), len(grades)
    kept = np.zeros(len(total), bool)
    for k in range(1, n_grades):
        m = int((grades >= k).sum())
        if 0 < m < n:
            above = np.bincount(held[grades[texts] >= k], minlength=len(total))
            p = total / n
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / m + 1 / (n - m)))
            kept |= (total >= MIN_TEXTS) & (np.abs(above / m - (total - above) / (n - m)) >= Z_LEAST * error)
    return np.flatnonzero(kept)


def fit(texts: Iterable[Counter], grades: list[int], n_grades: int, rounds: int = 800, ridge: float = 1e-4, pace: float = 0.1) -> tuple[dict[str, float], list[float]]:
    """Weights by feature and the n_grades - 1 ascending thresholds, by gradient steps on the mean log
    loss of P(grade >= k), summed over k, with a ridge on the weights. Texts are taken one by one."""
    number: dict[str, int] = {}
    features_of, gains_of = [], []
    for t in texts:
        features_of.append(np.array([number.setdefault(f, len(number)) for f in t], np.int64))
        gains_of.append(np.array([gain(n) for n in t.values()]))
    cols, vals = np.concatenate([*features_of, np.empty(0, np.int64)]), np.concatenate([*gains_of, np.empty(0)])
    rows = np.repeat(np.arange(len(grades)), [len(f) for f in features_of])
    chosen = telling(cols, rows, np.array(grades), n_grades) if len(cols) else cols
    names = {i: f for f, i in number.items()}
    words = sorted(names[i] for i in chosen.tolist())
    place = np.full(len(number), -1, np.int64)
    place[[number[w] for w in words]] = np.arange(len(words))
    cols = place[cols]
    rows, vals, cols = rows[cols >= 0], vals[cols >= 0], cols[cols >= 0]
    above = np.array([[g >= k for k in range(1, n_grades)] for g in grades], float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    theta = np.concatenate([np.zeros(len(words)), np.log((1 - share) / share)])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, t = theta[: len(words)], theta[len(words) :]
        s = np.bincount(rows, vals * w[cols], minlength=len(grades))
        p = 1 / (1 + np.exp(np.clip(t - s[:, None], -40, 40)))
        off = (p - above) / len(grades)
        grad = np.concatenate([np.bincount(cols, vals * off.sum(axis=1)[rows], minlength=len(words)) + ridge * w, -off.sum(axis=0)])
        # steps scaled by each weight's own gradients: a rare word learns as fast as a common one
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta -= pace * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-7)
        theta[len(words) :] = np.maximum.accumulate(theta[len(words) :])  # the thresholds stay ordered
    return {w: float(x) for w, x in zip(words, theta)}, theta[len(words) :].tolist()


def chosen_texts(docs: DataFrame, graded: DataFrame, n_grades: int, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, grade, text and number (`nth`, from 0) of at most `sample` labelled texts. A cut on the hash leaves about three times as
    many labels before anything moves; what repeats is one row. The rest is cut to `sample` by the hash, and numbered, without the
    texts, which stay where the join left them (an id may have several, so there may be more of them)."""
    scratch = scratch or Scratch(docs.sparkSession, "chosen")
    usable = graded.filter(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    mark = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    ids = usable.agg(F.approx_count_distinct("doc_id")).first()[0]
    cut = 1.0 if ids < 4 * sample else 3.0 * sample / ids
    # of the ids that the cut leaves (about 3 * sample, or 4) at most `sample` are looked up among the texts
    some = usable.filter(mark <= cut).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = scratch.save(texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "grade", F.xxhash64("text").alias("mark")).agg(F.min("text").alias("text")), "found")
    keys = found.select("doc_id", "grade", "mark").orderBy(F.xxhash64("doc_id", "grade", "mark"), "doc_id", "grade").limit(sample)
    numbers = scratch.save(keys.withColumn("nth", F.row_number().over(Window.orderBy("doc_id", "grade", "mark")) - 1), "numbers")
    return found.join(F.broadcast(numbers), ["doc_id", "grade", "mark"])


def train(docs: DataFrame, graded: DataFrame, n_grades: int, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]] | None:
    """The model from `graded` (doc_id, grade) and the texts of `docs`; None without two grades. The driver gets
    the grades of at most `sample` texts and their counts of the features that MIN_TEXTS of them have."""
    scratch = Scratch(docs.sparkSession, "train")
    rows = chosen_texts(docs, graded, n_grades, sample, scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("toxicity")
        for batch in batches:
            for nth, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features(WORD.findall(text.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([nth] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], ["nth", "feature", "n"])

    grades = [r.grade for r in rows.select("nth", "grade").orderBy("nth").collect()]
    if len(set(grades)) < 2:
        return None
    counts = scratch.save(rows.select("nth", "text").repartition(64, "nth").mapInArrow(count, "nth int, feature string, n int"), "counts")
    often = counts.groupBy("feature").agg(F.count("*").alias("texts")).filter(F.col("texts") >= MIN_TEXTS).select("feature")
    held = counts.join(often, "feature").orderBy("nth", "feature").toArrow()
    scratch.drop("found", "numbers", "counts")

    def texts() -> Iterator[Counter]:  # one at a time: the driver never holds all words as objects
        now, at = Counter(), 0
        for batch in held.to_batches(max_chunksize=1 << 14):
            for feature, nth, n in zip(*(batch.column(c).to_pylist() for c in ("feature", "nth", "n"))):
                while at < nth:
                    yield now
                    now, at = Counter(), at + 1
                now[feature] = n
        for _ in range(at, len(grades)):
            yield now
            now = Counter()

    return fit(texts(), grades, n_grades)


def predict(docs: DataFrame, model: tuple[dict[str, float], list[float]] | None, cut: float = CUT) -> DataFrame:
    """doc_id, severity (expected grade), grade (the largest k with P(grade >= k) >= cut), p_toxic and toxic."""
    weights, thresholds = model or ({}, [])
    # weights near nothing change no result that shows; the table stays small
    weights = {w: x for w, x in weights.items() if abs(x) > 1e-6}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("toxicity")
        find, known = WORD.findall, weights.keys()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                counts: Counter = Counter()
                for word, n in Counter(find((text or "").lower())).items():
                    for f in of_word(word):
                        if f in known:
                            counts[f] += n
                s = math.fsum(weights[w] * gain(n) for w, n in counts.items())
                ps = [1 / (1 + math.exp(min(40, max(-40, t - s)))) for t in thresholds] or [0.0]
                out.append((sum(ps), sum(p >= cut for p in ps), ps[0], ps[0] >= cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.float64(), pa.bool_())))], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 not toxic; 1 toxic; 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", grade.alias("grade"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    Scratch(spark, "toxicity")
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, severity_grades(table(spark, sf_dir, "labels")), 3))
