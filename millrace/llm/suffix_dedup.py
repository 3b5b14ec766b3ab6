"""Removal of passages that repeat across documents, by sorted suffixes.

A byte is removed if a string of `length` bytes that covers it also starts in a document of smaller id.
Suffixes are compared to `length` bytes; those that are equal so far are one run of the sorted order, and
the least doc_id of the run decides for all of it.

Only suffixes that may have an equal are sorted. Every string of `length` bytes has an anchor: of its
GRAM-byte grams the one of least hash, the leftmost if several. Equal strings have equal anchors, so
  1. `shared_anchors` finds the anchors that two documents have, by hash ranges;
  2. neighbouring suffixes of one anchor travel as one string (`neighbourhoods`), to the anchor's range;
  3. there `runs_of_equals` sorts them by deep-shallow sorting: multikey quicksort by 8-byte words to
     SHALLOW bytes, then a blind trie for each group that is still equal;
  4. the decisions go back to the documents, whose kept bytes are digested.
Texts move twice, each time dealt in buckets of bounded size; long texts are read in blocks. An anchor
that HEAVY rows or more have is dealt in salted parts of its range, which merge equal neighbourhoods before
they meet to be sorted; no pairs are made anywhere.
What still meets in one task: the list of rows that have an anchor (12 bytes each), in `shared_anchors`, and
the different neighbourhoods of an anchor.

Defined results: a null text is empty; a null doc_id counts as larger than all others; rows with equal
doc_ids don't remove from each other; texts shorter than `length` stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import worker

LENGTH, SHALLOW = 50, 16
#: Bytes of text a bucket holds, bytes of text whose anchors a range holds, and suffixes read at once.
BUCKET_BYTES, RANGE_BYTES, BLOCK = 2 << 20, 4 << 20, 1 << 17
LEAST_GROUPS = 64
#: Bytes of text whose anchors (12 bytes each, one in some 20 bytes) are matched in one range, and rows that are put together before
#: they are cut by ranges.
ANCHOR_RANGE_BYTES, HELD = 16 << 20, 1 << 17
#: Rows that make an anchor heavy, and buckets a salted part of a heavy anchor's range holds about.
HEAVY, PART_BUCKETS, LEAST_PARTS = 256, 64, 8
NO_ID = np.iinfo(np.int64).max
_RANDOM = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- anchors


def gram_size(length: int) -> int:
    return max(1, length // 2 - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes, put together from runs of powers of two."""
    power, width, whole, done = _RANDOM[data], 1, None, 0
    while True:
        if size & width:
            if whole is None:
                whole = power
            else:  # what is done so far stands first
                n = len(data) - done - width + 1
                whole = whole[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + n]
            done += width
        width *= 2
        if width > size:
            break
        power = power[: -(width // 2)] * np.uint64(pow(_BASE, width // 2, 1 << 64)) + power[width // 2 :]
    whole = whole ^ whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ whole >> np.uint64(32)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` keys, the place of its least one, the leftmost if several."""

    def least(one: slice, two: slice) -> tuple[np.ndarray, np.ndarray]:
        later = best[two] < best[one]
        return np.where(later, best[two], best[one]), np.where(later, at[two], at[one])

    best, at, have = keys, np.arange(len(keys)), 1
    while 2 * have <= width:
        best, at = least(slice(None, -have), slice(have, None))
        have *= 2
    if have < width:
        best, at = least(slice(None, len(keys) - width + 1), slice(width - have, len(keys) - have + 1))
    return at


def neighbourhoods(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts data[start:end], block by block: the anchor's hash, the first suffix's position in
    `data`, and how many neighbouring suffixes have that anchor (in a block, so a run may come in parts)."""
    size = gram_size(length)
    width = length - size + 1
    valid = np.zeros(len(data) + 1, np.int8)  # +1 and -1 where runs of suffixes begin and end
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        if len(part) < length:
            break
        hashes = gram_hashes(part, size)
        anchors = window_minima(hashes, width)
        here = np.flatnonzero(valid[at : at + len(anchors)])
        if not len(here):
            continue
        anchors = anchors[here]
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        yield hashes[anchors[first]], here[first] + at, np.diff(first, append=len(here))


def joined(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins and ends."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A range for each anchor. Anchors are least hashes, most of them small, so they are mixed once more."""
    hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(_BASE)
    hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def cuts_of(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of a sorted array."""
    first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1)) if len(sorted_) else np.empty(0, int)
    return list(zip(sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)]))


def together(pieces: Iterator[tuple[np.ndarray, ...]], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of rows put together until they are `least` or more, so that what is cut by ranges isn't cut small."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def wanted_only(pieces: Iterator[tuple[np.ndarray, ...]], wanted: np.ndarray, is_heavy: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of (hashes, at, counts), those whose hash is wanted, with its flag."""
    for hashes, at, counts in pieces:
        near = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        keep = np.flatnonzero(wanted[near] == hashes)
        yield hashes[keep], at[keep], counts[keep], is_heavy[near[keep]]


def shared_anchors(dealt: DataFrame, length: int, ranges: int, heavy: int) -> DataFrame:
    """bucket, hashes, heavy: the anchors in a bucket's texts that two rows or more have (8 bytes each), and
    for each a byte, 1 if `heavy` rows or more have it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("suffix_dedup")
        for batch in batches:
            data, starts, ends = joined(batch.column(2))
            buckets = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = []
            # empty texts begin where the next does; the last of equal starts is the one that has bytes
            found = ((hashes, np.searchsorted(starts, at, "right") - 1) for hashes, at, _ in neighbourhoods(data, starts, ends, length))
            for hashes, text in together(found, HELD):
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                once = np.ones(len(hashes), bool)  # a text counts once
                once[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                hashes, bucket = hashes[once], buckets[text[once]]
                where = range_of(hashes, ranges)
                order = np.lexsort((bucket, where))
                hashes, bucket, where = hashes[order], bucket[order].astype(np.int32), where[order]
                rows += [(r, hashes[a:b].tobytes(), bucket[a:b].tobytes()) for r, a, b in cuts_of(where)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["range", "hashes", "buckets"])

    def find(group: pa.Table) -> pa.Table:
        hashes, buckets = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("hashes", np.uint64), ("buckets", np.int32)))
        order = np.argsort(hashes)
        hashes, buckets = hashes[order], buckets[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        many = np.diff(first, append=len(hashes))
        rows_of = np.repeat(many, many)
        twice = rows_of > 1
        hashes, buckets, rows_of = hashes[twice], buckets[twice], rows_of[twice]
        order = np.argsort(buckets, kind="stable")
        hashes, buckets, rows_of = hashes[order], buckets[order], rows_of[order]
        rows = []
        for b, i, j in cuts_of(buckets):
            once, at = np.unique(hashes[i:j], return_index=True)
            rows.append((b, once.tobytes(), (rows_of[i:j][at] >= heavy).astype(np.uint8).tobytes()))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "hashes", "heavy"])

    packed = dealt.select("doc_id", "bucket", "text").mapInArrow(scan, "range int, hashes binary, buckets binary")
    return packed.groupBy("range").applyInArrow(find, "bucket int, hashes binary, heavy binary")


# ---------------------------------------------------------------- deep-shallow sorting


class BlindTrie:
    """A trie of the first `length` bytes of strings. Inner nodes hold the position in which their
    strings differ first, and no other bytes; so a new string goes down blindly, is compared once with
    the string it ends up at, and is hung in where the two differ."""

    __slots__ = ("length", "root")

    def __init__(self, length: int):
        self.length, self.root = length, None

    def insert(self, string: bytes, item: int) -> None:
        node = self.root
        if node is None:
            self.root = (string, [item])
            return
        while len(node) == 3:  # (position, children by byte, any leaf below)
            node = node[1].get(string[node[0]]) or node[2]
        known = node[0]
        if known == string:
            node[1].append(item)
            return
        low, high = 0, self.length
        while high - low > 1:  # where they differ first
            mid = (low + high) // 2
            if string[:mid] == known[:mid]:
                low = mid
            else:
                high = mid
        at, leaf = low, (string, [item])
        above, key, node = None, 0, self.root
        while len(node) == 3 and node[0] < at:
            above, key = node, string[node[0]]
            node = node[1][key]
        if len(node) == 3 and node[0] == at:
            node[1][string[at]] = leaf
            return
        new = (at, {known[at]: node, string[at]: leaf}, leaf)
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def leaves(self) -> Iterator[list[int]]:
        """The items of equal strings, in the strings' order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number that sorts as they do."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8")[:, 0].astype(np.uint64)


def multikey_order(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort with words of 8 bytes for letters: the suffixes' order by `depth` bytes, and
    the first of each group that is equal so far.

    A round parts every open group in three by its middle member's word: smaller, equal, larger. Equals go
    on with the next word; a group of one, or one that is equal in `depth` bytes, is closed."""
    order, seen = np.arange(len(at)), np.zeros(len(at), np.int64)  # seen: bytes in which a place's group is equal
    first = np.zeros(len(at), bool)  # where groups begin
    first[:1] = True
    while True:
        group = np.cumsum(first) - 1
        open_ = np.flatnonzero((np.bincount(group)[group] > 1) & (seen < depth)) if len(at) else order
        if not len(open_):
            return order, np.flatnonzero(first)
        of = group[open_]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        size = np.diff(begin, append=len(of))
        word = words_at(data, at[order[open_]] + seen[open_])
        pivot = np.repeat(word[begin + size // 2], size)
        side = (word > pivot).astype(np.int64) - (word < pivot)
        parted = 3 * of + side
        inner = np.argsort(parted, kind="stable")
        order[open_] = order[open_[inner]]
        seen[open_] += 8 * (side[inner] == 0)
        first[open_] |= np.diff(parted[inner], prepend=-2) != 0


def runs_of_equals(data: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Deep-shallow sorting of the suffixes of `data` at `at`: their indices in sorted order, those equal
    in `length` bytes together. `data` must go on for 8 bytes after the last suffix's `length`."""
    depth = min(shallow, length) // 8 * 8
    order, first = multikey_order(data, at, depth)
    view, raw = memoryview(data), at.tolist()
    order = order.tolist()
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        if j - i == 1:
            yield [order[i]]
            continue
        trie = BlindTrie(length - depth)
        for item in order[i:j]:
            trie.insert(bytes(view[raw[item] + depth : raw[item] + length]), item)
        yield from trie.leaves()


def least_ids(strings: np.ndarray, counts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For neighbourhoods (rows of bytes, with counts[i] suffixes and least id ids[i]): the least id that
    has each suffix's `length` bytes, in order of row and suffix."""
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.concatenate([strings.ravel(), np.zeros(8, np.uint8)])
    out = ids[row]
    for run in runs_of_equals(flat, row * strings.shape[1] + nth, length):
        if len(run) > 1:
            out[run] = out[run].min()
    return out


# ---------------------------------------------------------------- the passes

#: Neighbourhoods whose suffixes are sorted together, but for an anchor's own, which aren't parted.
SORTED_AT_ONCE = 4096


def slices(groups: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Parts of a sorted array of about `size` items that don't part a group."""
    at = 0
    while at < len(groups):
        end = len(groups) if at + size >= len(groups) else int(np.searchsorted(groups, groups[at + size - 1], "right"))
        yield at, end
        at = end


#: What travels of a neighbourhood, and how it is packed: many of one bucket and range in a row.
KINDS = {"anchors": np.uint64, "docs": np.int64, "texts": np.int32, "firsts": np.int64, "counts": np.uint8, "strings": np.uint8}


def unpacked(group: pa.Table, names: tuple[str, ...], span: int) -> tuple[dict[str, np.ndarray], list[int]]:
    """The neighbourhoods of a group's rows, one array a column, and how many each row holds."""
    press = zstandard.ZstdDecompressor()
    out, sizes = {}, []
    for name in names:
        blobs = group.column(name).to_pylist()
        if name == "strings":
            blobs = [press.decompress(x) for x in blobs]
        elif name == "anchors":
            sizes = [len(x) // 8 for x in blobs]
        out[name] = np.concatenate([np.frombuffer(x, KINDS[name]) for x in blobs])
    out["strings"], out["counts"] = out["strings"].reshape(-1, span), out["counts"].astype(np.int64)
    return out, sizes


def distinct(anchors: np.ndarray, counts: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal neighbourhoods stand together, by anchor, and where another one begins. The
    order of different ones depends on nothing but themselves."""

    def begins(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[:1] = True
        for key in keys:
            sorted_ = key[order]
            differ = sorted_[1:] != sorted_[:-1]
            out[1:] |= differ if differ.ndim == 1 else differ.any(axis=1)
        return out

    mark = counts.astype(np.uint64)  # finds equals; their bytes decide
    for k in range(strings.shape[1]):
        mark = mark * np.uint64(_BASE) + strings[:, k]
    order = np.lexsort((mark, anchors))
    fresh = begins(order, anchors, counts, strings)
    if (fresh != begins(order, anchors, mark)).any():  # two have one mark
        order = np.lexsort((*strings.T[::-1], counts, anchors))
        fresh = begins(order, anchors, counts, strings)
    return order, fresh


def settle(anchors: np.ndarray, counts: np.ndarray, strings: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For distinct neighbourhoods in order of their anchors, with the least id that has each: the least id
    that has each of their suffixes, in order of neighbourhood and suffix."""
    of = np.cumsum(np.diff(anchors, prepend=anchors[:1]) != 0)
    begin = np.cumsum(counts) - counts
    per_suffix = np.repeat(least, counts)
    # an anchor with one neighbourhood is in order already; equal suffixes have one anchor, so anchors are sorted some at a time
    pick = np.flatnonzero(np.bincount(of)[of] > 1)
    for i, j in slices(of[pick], SORTED_AT_ONCE):
        some = pick[i:j]
        sizes = counts[some]
        found = least_ids(strings[some], sizes, least[some], length)
        per_suffix[np.repeat(begin[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(found))] = found
    return per_suffix


def masked(part: dict[str, np.ndarray], bucket: np.ndarray, order: np.ndarray, fresh: np.ndarray, per_suffix: np.ndarray) -> pa.Table:
    """For each bucket, texts' suffixes to remove: index of the text in its bucket, position of the first
    suffix, and a mask whose bit k says that its k-th suffix also starts in a document of smaller id."""
    counts, docs, kind = part["counts"][order], part["docs"][order], np.cumsum(fresh) - 1
    sizes = counts[fresh]
    begin = np.cumsum(sizes) - sizes
    mask = np.zeros(len(order), np.int64)
    for k in range(int(counts.max(initial=0))):
        has = np.flatnonzero(counts > k)
        mask[has] |= (per_suffix[begin[kind[has]] + k] < docs[has]).astype(np.int64) << k
    hit = np.flatnonzero(mask)
    hit = hit[np.argsort(bucket[order[hit]], kind="stable")]
    rows = order[hit]
    out = [(b, part["texts"][rows[i:j]].tobytes(), part["firsts"][rows[i:j]].tobytes(), mask[hit[i:j]].tobytes()) for b, i, j in cuts_of(bucket[rows])]
    return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "texts", "firsts", "masks"])


HITS = "bucket int, texts binary, firsts binary, masks binary"


def decided_light(near: DataFrame, length: int) -> DataFrame:
    """Neighbourhoods of anchors that few texts have: each range of anchors decides at once."""
    span = 2 * length - gram_size(length)

    def decide(group: pa.Table) -> pa.Table:
        part, sizes = unpacked(group, tuple(KINDS), span)
        bucket = np.repeat(np.array(group.column("bucket").to_pylist(), np.int32), sizes)
        order, fresh = distinct(part["anchors"], part["counts"], part["strings"])
        first = np.flatnonzero(fresh)
        least = np.minimum.reduceat(part["docs"][order], first)
        chosen = order[first]
        return masked(part, bucket, order, fresh, settle(part["anchors"][chosen], part["counts"][chosen], part["strings"][chosen], least, length))

    return near.groupBy("range").applyInArrow(decide, HITS)


def decided_heavy(scratch: Scratch, near: DataFrame, length: int) -> DataFrame:
    """Neighbourhoods of anchors that many texts have: salted parts of a range keep one of equals, with its
    least id; the range settles what its parts kept; each part then decides for its own texts."""
    span = 2 * length - gram_size(length)
    kept = ("anchors", "docs", "counts", "strings")

    def reduce(group: pa.Table) -> pa.Table:
        part, _ = unpacked(group, kept, span)
        order, fresh = distinct(part["anchors"], part["counts"], part["strings"])
        first = np.flatnonzero(fresh)
        least, chosen = np.minimum.reduceat(part["docs"][order], first), order[first]
        blobs = (part["anchors"][chosen].tobytes(), least.tobytes(), part["counts"][chosen].astype(np.uint8).tobytes(), zstandard.ZstdCompressor(level=1).compress(part["strings"][chosen].tobytes()))
        return pa.table([group.column("range")[:1], group.column("part")[:1], *(pa.array([x], pa.binary()) for x in blobs)], ["range", "part", *kept])

    def agree(group: pa.Table) -> pa.Table:
        all_, sizes = unpacked(group, kept, span)
        order, fresh = distinct(all_["anchors"], all_["counts"], all_["strings"])
        first = np.flatnonzero(fresh)
        least, chosen = np.minimum.reduceat(all_["docs"][order], first), order[first]
        per_suffix = settle(all_["anchors"][chosen], all_["counts"][chosen], all_["strings"][chosen], least, length)
        begin = np.cumsum(all_["counts"][chosen]) - all_["counts"][chosen]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        ids, at = [], 0
        for size in sizes:  # a part's neighbourhoods stand in their own order
            mine, many = kind[at : at + size], all_["counts"][at : at + size]
            ids.append(per_suffix[np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes())
            at += size
        return pa.table([group.column("range"), group.column("part"), pa.array(ids, pa.binary())], ["range", "part", "ids"])

    def answer(group: pa.Table, settled: pa.Table) -> pa.Table:
        part, sizes = unpacked(group, tuple(KINDS), span)
        bucket = np.repeat(np.array(group.column("bucket").to_pylist(), np.int32), sizes)
        order, fresh = distinct(part["anchors"], part["counts"], part["strings"])
        return masked(part, bucket, order, fresh, np.frombuffer(settled.column("ids")[0].as_py(), np.int64))

    parts = near.groupBy("range", "part").applyInArrow(reduce, "range int, part int, anchors binary, docs binary, counts binary, strings binary")
    settled = scratch.save(parts.groupBy("range").applyInArrow(agree, "range int, part int, ids binary"), "settled")
    return near.groupBy("range", "part").cogroup(settled.groupBy("range", "part")).applyInArrow(answer, HITS)


def in_order(docs: pa.Table) -> pa.Table:
    """A bucket's rows in an order that each pass finds again: equal rows are interchangeable."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, ranges: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of struct start, end: the maximal removed runs of bytes) and
    kept_sha256 of each row."""
    if not 8 <= length <= 100:
        raise ValueError("length 8 to 100")
    scratch = Scratch(spark, "repeats", batch_bytes=4 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(LEAST_GROUPS, total // BUCKET_BYTES)
    ranges = ranges or max(LEAST_GROUPS, total // RANGE_BYTES)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    parts = max(LEAST_PARTS, buckets // PART_BUCKETS)
    shared = scratch.save(shared_anchors(dealt, length, min(ranges, max(LEAST_GROUPS, total // ANCHOR_RANGE_BYTES)), heavy), "shared")
    size = gram_size(length)
    span = 2 * length - size

    def gather(texts: pa.Table, known: pa.Table) -> pa.Table:
        names = ["range", "part", "bucket", *KINDS]
        types = (pa.int32(), pa.int32(), pa.int32(), *(pa.binary(),) * 6)
        wanted, is_heavy = (np.concatenate([np.frombuffer(x, t) for x in known.column(c).to_pylist()] or [np.empty(0, t)]) for c, t in (("hashes", np.uint64), ("heavy", np.uint8)))
        order = np.argsort(wanted)
        wanted, is_heavy = wanted[order], is_heavy[order]
        out, press = [], zstandard.ZstdCompressor(level=1)
        if len(wanted) and texts.num_rows:
            texts = in_order(texts)
            data, starts, ends = joined(texts.column("text"))
            ids = texts.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
            bucket = texts.column("bucket")[0].as_py()
            padded = np.concatenate([data, np.zeros(span, np.uint8)])
            for hashes, at, counts, flags in together(wanted_only(neighbourhoods(data, starts, ends, length), wanted, is_heavy), HELD):
                where = 2 * range_of(hashes, ranges) + flags
                order = np.lexsort((hashes, where))
                hashes, at, counts, where = hashes[order], at[order], counts[order], where[order]
                text = np.searchsorted(starts, at, "right") - 1
                strings = np.lib.stride_tricks.sliding_window_view(padded, span)[at]
                strings[np.arange(span) >= (counts + length - 1)[:, None]] = 0
                columns = (hashes, ids[text], text.astype(np.int32), at - starts[text], counts.astype(np.uint8))
                out += [(w >> 1, (1 + bucket % parts) * (w & 1), bucket, *(c[i:j].tobytes() for c in columns), press.compress(strings[i:j].tobytes())) for w, i, j in cuts_of(where)]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    schema = "range int, part int, bucket int, " + ", ".join(f"{c} binary" for c in KINDS)
    near = scratch.save(dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(gather, schema), "near")
    scratch.drop("shared")
    light = scratch.save(decided_light(near.filter("part = 0"), length), "light")
    hot = scratch.save(decided_heavy(scratch, near.filter("part > 0"), length), "heavy")
    scratch.drop("near", "settled")
    decided = light.union(hot)

    def cut(texts: pa.Table, hits: pa.Table) -> pa.Table:
        texts = in_order(texts)
        data, starts, ends = joined(texts.column("text"))
        change = np.zeros(len(data) + 1, np.int32)
        for t, f, m in zip(*(hits.column(c).to_pylist() for c in ("texts", "firsts", "masks"))):
            at, mask = starts[np.frombuffer(t, np.int32)] + np.frombuffer(f, np.int64), np.frombuffer(m, np.int64)
            for k in range(int(mask.max(initial=0)).bit_length()):
                hit = at[mask >> k & 1 == 1] + k
                np.add.at(change, hit, 1)
                np.add.at(change, hit + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        view, out = memoryview(data), []
        for a, b in zip(starts.tolist(), ends.tolist()):
            here = gone[a:b]
            if not here.any():
                out.append((b - a, 0, [], hashlib.sha256(view[a:b]).hexdigest()))
                continue
            edges = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0)).tolist()
            spans = [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])]
            out.append((b - a, int(here.sum()), spans, hashlib.sha256(data[a:b][~here].tobytes()).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        return pa.table([texts.column("doc_id").combine_chunks(), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return dealt.groupBy("bucket").cogroup(decided.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
