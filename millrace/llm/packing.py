"""Best-two-fit packing of tokenised documents into fixed-size sequences.

Only lengths decide how pieces fit, and there are at most `size` distinct lengths however many
documents there are. So the plan is made from the histogram of lengths: a bin is filled greedily, the
longest piece that fits first; then its smallest piece is replaced by the two unpacked pieces that fit
the widened gap most tightly, if they fill it better. The same bin is repeated while its lengths last,
so the plan is a short list of patterns with counts. Pieces get a rank among those of their length
(in hashed buckets, so a length that a third of all rows share is not one task's work), and the plan
turns (length, rank) into a sequence and an offset.

Defined results: a null or empty text is the closing id alone; documents longer than a sequence are cut
into whole sequences and a rest; rows with equal doc_ids are packed each; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import worker

SIZE = 2048
CLOSING_ID = 0
#: Words whose ids a worker remembers until another operator begins; those met since then, and as many from before.
CACHE_WORDS = 150_000
#: Characters whose classes and case are the same to Python and to any tokenizer, and that NFC leaves
#: alone; a text with others goes to the tokenizer whole.
UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-įı-ȶ]")
PLAIN = bytes([9, 10, 13, *range(32, 127)])
#: Lower-case letters of those, then contractions, digits one by one, and runs of what is left.
LETTERS = "a-zªµºß-öø-ʯ"
WORD = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{LETTERS}]+")


class WordTokenizer:
    """Ids of whole texts by a lower-casing BPE with word ends, each distinct word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 3, bool)
        self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        return worker.kept(path, lambda: cls(path))

    def plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.whole.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(ids) and cuts[-1] != len(ids)):
            self.cache.update((w, self.plain(w)) for w in words)
            return
        raw, at = ids.tobytes(), 0
        for w, cut in zip(words, (4 * cuts).tolist()):
            self.cache[w] = raw[at:cut]
            at = cut

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit words."""
        if not text:
            return b""
        unusual = text.encode().translate(None, PLAIN) if text.isascii() else UNUSUAL.search(text)
        if unusual or any(t in text for t in self.added):
            return self.plain(text)
        words = WORD.findall(text.lower())
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.before = {}, self.cache
        get = self.cache.__getitem__
        try:
            return b"".join(map(get, words))
        except KeyError:
            missing = [w for w in set(words) if w not in self.cache]
            self.cache.update((w, self.before[w]) for w in missing if w in self.before)
            if missing := [w for w in missing if w not in self.cache]:
                self.learn(missing)
            return b"".join(map(get, words))


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most `size` tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("packing")
        encode = WordTokenizer.of(tokenizer).encode
        closing, wide = CLOSING_ID.to_bytes(4, "little"), 4 * size
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + closing
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] pieces: (how many bins, [(length, pieces of it in each)]), longest first."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while True:
        free = np.flatnonzero(left)
        if not len(free):
            return plan
        gap, bin_ = size, {}
        while gap and len(free := free[: np.searchsorted(free, gap, "right")]):
            length = int(free[-1])
            take = int(min(left[length], gap // length))
            bin_[length] = take
            gap -= take * length
            free = free[:-1]
        if gap:
            small = min(bin_)
            spare = left.copy()
            for length, n in bin_.items():
                spare[length] -= n
            open_ = np.flatnonzero(spare[: small + gap + 1])
            if len(open_):
                # for each first piece, the longest second that still fits the gap and the smallest's room
                second = np.searchsorted(open_, small + gap - open_, "right") - 1
                ok = second >= 0
                first, second = open_[ok], open_[second[ok]]
                same = (first == second) & (spare[first] < 2)
                if same.any():  # a lone piece can't be taken twice: the next shorter one
                    lower = np.searchsorted(open_, second[same]) - 1
                    second[same] = np.where(lower >= 0, open_[np.maximum(lower, 0)], -size)
                total = first + second
                if len(total) and (best := int(total.argmax())) >= 0 and total[best] > small:
                    bin_[small] -= 1
                    for length in (int(first[best]), int(second[best])):
                        bin_[length] = bin_.get(length, 0) + 1
        bin_ = {k: n for k, n in bin_.items() if n}
        times = min(int(left[k]) // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= times * n
        plan.append((times, sorted(bin_.items(), reverse=True)))


def placement(plan: list[tuple[int, list[tuple[int, int]]]], size: int) -> tuple[np.ndarray, ...]:
    """The plan by (length, rank): sorted keys length * 2^48 + first rank, and for each the pieces a
    bin, first sequence and first offset. As long as the plan, whatever the number of pieces."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, bin_ in plan:
        offset = 0
        for length, n in bin_:
            lo = used.get(length, 0)
            used[length] = lo + n * times
            rows.append(((length << 48) + lo, n, base, offset))
            offset += n * length
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """`pieces` of the documents with sequence_id and offset, in few sequences of at most `size` tokens."""
    scratch = Scratch(spark, "pack")
    cut = scratch.save(pieces(docs, tokenizer, size), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    keys, per_bin, base, first = placement(best_two_fit(counts, size), size)
    buckets = max(64, sum(counts.values()) // 100_000)
    order = Window.partitionBy("length", "bucket")
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    ranked = (
        dealt.withColumn("at", F.row_number().over(order.orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("packing")
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            nth = rank - (keys[row] & (1 << 48) - 1)
            sequence, offset = base[row] + nth // per_bin[row], first[row] + nth % per_bin[row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path())
