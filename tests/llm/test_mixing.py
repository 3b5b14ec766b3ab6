import random
import re

import pytest

from millrace.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, copies string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in rows], SCHEMA)


def brute_targets(by, weights, share, most):
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(by.values()), set(by), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * by[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * by[s]
            left -= out[s]
            free.discard(s)
    return out


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus(seed, n):
    rng = random.Random(seed)
    sources = ["b", "a", None, "Z", "é", "zz", "", "empty"]
    rows = [(i, None if rng.random() < 0.05 else " ".join("w" * rng.randint(0, 1) or "x" for _ in range(int(rng.expovariate(0.02)))), rng.choice(sources[:-1] if rng.random() < 0.7 else ["b"])) for i in range(n)]
    return rows + [(n + k, "", "empty") for k in range(3)]


@pytest.mark.parametrize("seed, weights, share", [(1, (5, 2, 1), 1.5), (2, (1,), 0.3), (3, (9, 1), 1.99), (4, (5, 2, 1), 2.5)])
def test_mix(spark, seed, weights, share):
    rows = corpus(seed, 900)
    got = M.mix(spark, frame(spark, rows), weights, share).collect()
    by, size = {}, {}
    for i, t, s in rows:
        size[i] = n_words(t)
        by[s] = by.get(s, 0) + size[i]
    want = brute_targets(by, weights, share, 2)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(by, 0)
    assert sorted(r.doc_id for r in got) == sorted(source)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by[s])
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * by[s])


def test_inclusion_is_unequal_and_as_stated(spark):
    """Of documents of one class of length, the share that is drawn once more is p; classes differ in it."""
    rows = [(i, "w " * (3, 10, 40, 160)[i % 4], "a" if i % 3 else "b") for i in range(12000)]
    got = M.mix(spark, frame(spark, rows), (1, 3), 0.6).collect()
    by = {}
    for r in got:
        assert r.copies in (int(r.copies > 0),) and r.copies <= 1 or r.source == "b"
        by.setdefault((r.source, r.size), []).append((r.copies, r.p))
    rates = {}
    for key, drawn in by.items():
        expected = drawn[0][1] + (1 if min(c for c, _ in drawn) >= 1 else 0)
        rates[key] = sum(c for c, _ in drawn) / len(drawn)
        assert abs(rates[key] - expected) < 0.05, key
    assert rates["a", 160] > 2 * rates["a", 10] > 2 * rates["a", 3] > 0  # alike for all, it would be no such sample


def test_order_is_by_odds(spark):
    """The sample is the head of the ranking by random odds over inclusion odds, but for the closing document."""
    rows = [(i, "w " * (1 + i % 60), "a") for i in range(4000)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in M.mix(spark, df, (1,), 0.3).collect()}
    marks = {r.doc_id: r.u for r in M.sizes(df).selectExpr("doc_id", "shiftrightunsigned(xxhash64(mark, 42), 11) as u").collect()}
    odds = lambda x: x / (1 - x)
    ranked = sorted((odds((marks[i] + 0.5) / 2**53) / odds(r.p), r.copies) for i, r in got.items() if 0 < r.p)
    copies = [c for _, c in ranked]
    assert sum(a != b for a, b in zip(copies, copies[1:])) <= 3 and copies[0] == max(copies)


def test_reruns_and_partitions_agree(spark):
    df = frame(spark, corpus(7, 500))
    one = sorted(map(tuple, M.mix(spark, df).drop("source").collect()))
    two = sorted(map(tuple, M.mix(spark, df.repartition(7)).drop("source").collect()))
    assert one == two


def test_repeated_rows_and_one_document(spark):
    rows = [(1, "a b c", "s")] * 4
    got = M.mix(spark, frame(spark, rows)).collect()
    assert sum(r.taken for r in got) == 18
    got = M.mix(spark, frame(spark, [(1, "a b c d", None)])).collect()
    assert got[0].target == 6.0 and got[0].copies in (1, 2)


def test_mixed_rows(spark):
    df = frame(spark, corpus(9, 300))
    copies = {r.doc_id: r.copies for r in M.mix(spark, df).collect()}
    out = M.mixed(spark, df)
    assert out.columns == df.columns
    again = M.mixed(spark, df.unionByName(df.filter("doc_id < 9")))  # rows that repeat
    assert {r.doc_id for r in again.collect()} <= set(copies)
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: c for i, c in copies.items() if c}


def test_rows_without_id_are_drawn_each(spark):
    rows = [(None, f"word{i} and more", "s") for i in range(400)]
    got = M.mix(spark, frame(spark, rows), (1,), 0.5).collect()
    assert abs(sum(r.copies for r in got) - 200) <= 1
    assert sum(1 for _ in M.mixed(spark, frame(spark, rows)).collect()) == sum(r.copies for r in M.mix(spark, frame(spark, rows)).collect())


def test_empty_table(spark):
    assert M.mix(spark, frame(spark, [])).count() == 0
