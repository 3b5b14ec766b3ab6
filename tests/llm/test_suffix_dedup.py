import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import suffix_dedup as S


def brute(rows, length):
    where = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            where[s] = min(where.get(s, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if where[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 8))]
        if rows and rng.random() < 0.2:
            parts.append((rows[rng.randrange(len(rows))][1] or "").replace("a", "b", rng.randint(0, 3)))
        rows.append((rng.randrange(n * 3) * 1000 + i, rng.choice([" ", ""]).join(parts)))
    return rows + [(5, None), (6, ""), (7, "x" * 400), (8, "x" * 300), (9, "\0" * 120), (10, "\0" * 119 + "a"), (11, "z" * 49), (12, "z" * 49), (13, "y" * 50), (14, "y" * 50)]


@pytest.mark.parametrize("length, seed", [(50, 1), (50, 2), (17, 3)])
def test_matches_brute_force(spark, length, seed):
    rows = corpus(seed, 120)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, bucket int, range string")
    got = S.repeats(spark, df, length, buckets=5, ranges=4).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("heavy", [2, 4])
def test_heavy_anchors_in_salted_parts(spark, heavy):
    # one passage in most documents, in different surroundings, and a large group of copies
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdef") * rng.randint(1, 5) for _ in range(40))
    rows = corpus(8, 60) + [(10**6 + 7 * k % 90, f"{k} {passage} {k % 3}") for k in range(90)] + [(2 * 10**6 + k, passage * 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeats(spark, df, 50, buckets=40, ranges=3, heavy=heavy).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows, 50)


def test_order_of_distinct_neighbourhoods_ignores_input_order():
    rng = np.random.default_rng(6)
    anchors, counts = rng.integers(0, 3, 300).astype(np.uint64), rng.integers(1, 3, 300)
    strings = rng.integers(0, 2, (300, 5)).astype(np.uint8)
    found = []
    for way in (np.arange(300), rng.permutation(300)):
        order, fresh = S.distinct(anchors[way], counts[way], strings[way])
        chosen = way[order[fresh]]
        found.append([(anchors[i], counts[i], *strings[i]) for i in chosen])
        assert len(set(found[-1])) == len(found[-1]) == len({(a, c, *s) for a, c, s in zip(anchors, counts, strings)})
    assert found[0] == found[1]


def test_long_texts_in_blocks(spark, monkeypatch):
    # the same code in this process, with small blocks: anchors don't depend on where blocks begin
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts, ends = np.array([0, 0, 1000, 1030, 4000]), np.array([0, 1000, 1030, 4000, 5000])

    def all_of():
        out = {}
        for hashes, at, counts in S.neighbourhoods(data, starts, ends, 50):
            for h, a, c in zip(hashes.tolist(), at.tolist(), counts.tolist()):
                out.update({a + k: h for k in range(c)})
        return out

    whole = all_of()
    assert sorted(whole) == [p for a, b in zip(starts, ends) for p in range(a, b - 49)]
    monkeypatch.setattr(S, "BLOCK", 97)
    assert all_of() == whole


def test_deep_shallow_order():
    rng = random.Random(4)
    for alphabet, length, shallow in (("ab", 20, 8), ("ab", 20, 16), ("abc", 12, 16), ("a", 30, 16), ("ab", 9, 0)):
        raw = "".join(rng.choice(alphabet) for _ in range(400)).encode()
        data = np.frombuffer(raw + bytes(64), np.uint8)
        at = np.array(rng.sample(range(400 - length), 250))
        runs = list(S.runs_of_equals(data, at, length, shallow))
        order = [i for run in runs for i in run]
        strings = [bytes(data[at[i] : at[i] + length]) for i in order]
        assert sorted(order) == list(range(250)) and strings == sorted(strings)
        for run in runs:
            assert len({bytes(data[at[i] : at[i] + length]) for i in run}) == 1
        assert len(runs) == len(set(strings))


def test_ranges_hold_alike_many_anchors():
    data = np.random.default_rng(5).integers(97, 123, 300_000).astype(np.uint8)
    anchors = np.concatenate([h for h, _, _ in S.neighbourhoods(data, np.array([0]), np.array([len(data)]), 50)])
    held = np.bincount(S.range_of(anchors, 64), minlength=64)
    assert held.max() < 1.3 * held.mean() and held.min() > 0.7 * held.mean()


def test_slices_keep_groups_whole():
    groups = np.repeat(np.arange(50), np.random.default_rng(3).integers(1, 9, 50))
    for size in (1, 4, 30, 1000):
        parts = list(S.slices(groups, size))
        assert [i for i, _ in parts] == [0, *(j for _, j in parts[:-1])] and parts[-1][1] == len(groups)
        assert all(groups[j - 1] != groups[j] for _, j in parts[:-1])
    assert list(S.slices(groups[:0], 4)) == []


def test_grams_hash_alike():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcx", np.uint8)
    for size in range(1, 25):
        h = S.gram_hashes(data, size)
        assert len(h) == len(data) - size + 1
        seen = {}
        for k in range(len(h)):
            assert seen.setdefault(bytes(data[k : k + size]), h[k]) == h[k]
        assert len(set(seen.values())) == len(seen)


def test_no_ids_ties_and_empty_table(spark):
    text = "w" * 10 + "-" * 60
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (None, "q" * 80), (None, "q" * 80)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in S.repeats(spark, df).collect())
    assert got == [(False, 0), (False, 0), (True, 0), (True, 0), (True, 70)]
    assert S.repeats(spark, df.limit(0)).count() == 0
