import random
import re

import pytest
import xxhash

from millrace.llm import simhash as S
from millrace.session import Scratch


def brute_print(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one TWO", "ÀB c d e f g", "a b c", *(" ".join(rng.choice("AbcdeÉ") for _ in range(rng.randint(1, 60))) for _ in range(60))]
    for n in (3, 5):
        for t in texts:
            assert S.fingerprint(t, n) & (1 << 64) - 1 == brute_print(t, n)


def test_blocks_of_shingles_join_up(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = S.fingerprint(text, 3)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text, 3) == whole


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).selectExpr("xxhash64('a b c') AS h").first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [0, 2])
def test_components_match_brute_force(spark, radius):
    rng = random.Random(radius)
    prints = {}
    for c in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            if rng.random() < 0.8:
                base ^= sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3)))
            prints[len(prints)] = base
    prints[len(prints)] = 0
    prints[len(prints)] = 1 << 63
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints.items()]
    nodes = spark.createDataFrame(signed, "id long, fp long").select("fp").distinct()
    scratch = Scratch(spark, "t")
    stars = S.components(scratch, S.ball_links(scratch, nodes, radius))
    root = {r.node & (1 << 64) - 1: r.root for r in stars.collect()}
    want = brute_components(prints, radius)
    classes = {}
    for i, f in prints.items():
        classes.setdefault(root.get(f, f), set()).add(i)
    expect = {}
    for i, c in want.items():
        expect.setdefault(c, set()).add(i)
    # equal fingerprints are one node
    merged = {frozenset(v) for v in classes.values()}
    if radius == 0:
        assert all(len({prints[i] for i in g}) == 1 for g in merged)
    assert merged == {frozenset(v) for v in expect.values()}


def test_documents(spark):
    words = [f"w{i}" for i in range(400)]
    near = list(words)
    near[200] = "other"
    rows = [(5, " ".join(words), "u"), (3, " ".join(words).upper(), "u"), (9, None, None), (8, " ", "v"), (7, "solo", "w")]
    got = {r.doc_id: r for r in S.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string, fp string"), n=3).collect()}
    assert got[5].component_id == got[3].component_id == 3
    assert got[9].fp == got[8].fp == 0 and got[9].component_id == got[8].component_id == 8
    assert got[7].component_id == 7


def test_empty_table(spark):
    assert S.near_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
