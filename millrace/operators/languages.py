"""A language detector by rank-order profiles of letter n-grams, in DataFrame operations.

A profile is the PROFILE most frequent n-grams (1 to 3 letters, words between spaces) of a language's labelled texts, or of a text, in
order. A text's language is the one whose profile is nearest: the sum over the text's n-grams of how far their ranks are
apart, PROFILE for one that the language's profile lacks. Profiles of languages are small (PROFILE rows each) and broadcast after a check.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches

PROFILE, LEAST = 300, 64
#: Most rows of profiles that are broadcast.
BROADCAST_ROWS = 100_000


#: Bytes of texts that a worker takes at a time.
BATCH_BYTES = 4 << 20


def _letters(text: str) -> Column:
    return F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}]+", " ")


def _counted(words: list[str]) -> Counter:
    """The n-grams of words between spaces: pieces of the words in a row, but those with a space in their middle."""
    row = f" {' '.join(words)} "
    out = Counter(row)
    out.update(map(str.__add__, row, row[1:]))
    out.update(x + y + z for x, y, z in zip(row, row[1:], row[2:]) if y != " ")
    del out[" "]
    return out


def grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram and n: the n-grams of each key's lower-case words, put together within a worker's batch before they are shuffled."""
    bound_batches(df.sparkSession, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict = {}
            for name, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := [w for w in (said or "").split(" ") if w]:
                    counts.setdefault(name, Counter()).update(_counted(words))
            for name, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), batch.schema.types[0]), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "gram", "n"])

    kind = dict(df.dtypes)[key]
    each = df.select(F.col(key).alias("key"), _letters(text)).mapInArrow(run, f"key {kind}, gram string, n long")
    return each.groupBy(F.col("key").alias(key), "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, key: str) -> DataFrame:
    """key, gram and rank (from 0) of its PROFILE most frequent n-grams."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).filter(F.col("rank") < PROFILE).drop("n")


def fit(labelled: DataFrame, text: str, language: str) -> DataFrame:
    """The profiles of the languages of labelled rows."""
    return profiles(grams(labelled.filter(F.col(language).isNotNull()), language, text), language).withColumnRenamed(language, "language")


def detect(df: DataFrame, id_col: str, text: str, model: DataFrame, least: int = LEAST) -> DataFrame:
    """id and language of each row (ids are unique); null for a text under `least` characters, or without an n-gram that a profile has. A text's
    n-grams are counted and compared in its own row, so nothing is shuffled; a model of more than BROADCAST_ROWS rows is joined."""
    bound_batches(df.sparkSession, BATCH_BYTES)
    kind = dict(df.dtypes)[id_col]
    asked = df.select(F.col(id_col).alias("id"), F.when(F.length(text) >= least, _letters(text)).alias("said"))

    def own(said: str) -> list[str]:
        """A text's profile: its n-grams by rank."""
        words = [w for w in said.split(" ") if w]
        counts = _counted(words) if words else {}
        least_n = sorted(counts.values(), reverse=True)[PROFILE - 1] if len(counts) > PROFILE else 0
        return sorted((g for g, n in counts.items() if n >= least_n), key=lambda g: (-counts[g], g))[:PROFILE]

    rows = model.select("language", "gram", "rank").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        names = sorted({r.language for r in rows})
        place = {g: k for k, g in enumerate(dict.fromkeys(r.gram for r in rows))}
        ranks = np.full((len(place), len(names)), -1, np.int16)
        of = {x: k for k, x in enumerate(names)}
        for r in rows:
            ranks[place[r.gram], of[r.language]] = r["rank"]
        sent = df.sparkSession.sparkContext.broadcast((place, ranks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, ranks = sent.value
            for batch in batches:
                out = []
                for said in batch.column(1).to_pylist():
                    met = [(place[g], k) for k, g in enumerate(own(said) if said else ()) if g in place]
                    if not met:
                        out.append(None)
                        continue
                    at, rank = np.array(met, np.int64).T
                    in_model = ranks[at].astype(np.int64)
                    have = in_model >= 0
                    gain = np.where(have, PROFILE - np.abs(rank[:, None] - in_model), 0).sum(0)
                    best = gain[have.any(0)].max()
                    out.append(names[np.flatnonzero(have.any(0) & (gain == best))[-1]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "language"])

        return asked.mapInArrow(run, f"id {kind}, language string").withColumnRenamed("id", id_col)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own(said) if said else [] for said in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["id", "grams"])

    each = asked.mapInArrow(profile, f"id {kind}, grams array<string>").select("id", F.posexplode("grams").alias("rank", "gram"))
    near = each.join(model.select("language", "gram", F.col("rank").alias("in_model")), "gram").groupBy("id", "language").agg(F.sum(PROFILE - F.abs(F.col("rank") - F.col("in_model"))).alias("gain"))
    best = near.groupBy("id").agg(F.max(F.struct("gain", "language"))["language"].alias("language"))
    return df.select(F.col(id_col)).join(best.withColumnRenamed("id", "_of"), F.col(id_col) == F.col("_of"), "left").select(id_col, "language")
