import random

import corpus_pipeline as C
import numpy as np

from millrace.llm import mixing, packing, simhash
from millrace.session import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(60, 300)))
        rows.append((i, t, rng.choice(["en", "fr"]), f"s{i % 4}", len(t)))
    exact = [(n + k, rows[k][1], "en", "s1", 1) for k in range(0, n, 5)]
    near = []
    for k in range(0, n, 4):
        w = rows[k][1].split()
        w[len(w) // 2] = "changed"
        near.append((2 * n + k, " ".join(w), "en", "s2", 1))
    junk = [(9000, None, None, None, None), (9001, "", "en", "s1", 0), (9002, "123 -- 45", "en", "s1", 1), (9003, "lone", None, None, 4)]
    return rows, exact, near, junk


def test_near_dedup_keeps_one_of_each_group(spark):
    rows, _, near, _ = corpus(1, 80)
    out = simhash.near_dedup(spark, spark.createDataFrame(rows + near, SCHEMA))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    kept = {r.doc_id for r in out.collect()}
    assert {r[0] for r in rows} <= kept
    assert len(kept & {r[0] for r in near}) <= 1


def test_near_dedup_verifies_and_survives_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "a"), (4, "a"), (None, "a"), (5, "a b c d e f g h i j"), (6, "j i h g f e d c b a")]
    kept = sorted(r.doc_id or 0 for r in simhash.near_dedup(spark, spark.createDataFrame(odd, "doc_id long, text string")).collect())
    assert kept == [1, 3, 5, 6]  # equal words in another order are no copy
    same_id = [(1, "a b c d e f g h"), (1, "i j k l m n o p"), (2, "i j k l m n o p"), (3, "q r s t u v w x"), (3, "q r s t u v w x"), (None, "lone words here of no one"), (None, "a b c d e f g h")]
    kept = sorted((r.doc_id or 0, r.text[0]) for r in simhash.near_dedup(spark, spark.createDataFrame(same_id, "doc_id long, text string")).collect())
    assert kept == [(0, "l"), (1, "a"), (1, "i"), (3, "q")]  # each row by its own text
    assert simhash.near_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_compares_all_texts_of_one_fingerprint(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    orders = [rng.sample(words, 300) for _ in range(3)]
    copy = list(orders[1])
    copy[100], copy[101] = copy[101], copy[100]  # neither the least id nor the one before holds its original
    rows = [(i + 1, " ".join(w)) for i, w in enumerate([*orders, copy])]
    kept = simhash.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def just_alike(seed, n):
    """n texts, each with a copy in which so many words are changed that the similarity stays just above 0.8."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(95, 280))]
        copy = list(t)
        for k in range(len(t) // 48):
            copy[20 + 40 * k] = f"new{i}x{k}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(copy))]
    return rows


def test_near_dedup_loses_no_pair(spark):
    rows = just_alike(5, 60)
    assert all(simhash.similarity(rows[i][1], rows[i + 1][1], 5) >= 0.8 for i in range(0, 120, 2))
    kept = simhash.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 2))


def test_near_dedup_recall_against_brute_force(spark):
    """Queries: the texts of every id divisible by 20, against all; none of their links of 0.8 or more is lost."""
    rng = random.Random(8)
    rows = just_alike(6, 420)
    passage = [f"p{k}" for k in range(60)]  # shared by many texts, which makes some of them alike and most not
    for i in range(1000, 1300):
        rows.append((i, " ".join(passage + [f"o{i}x{k}" for k in range(rng.randint(0, 30))])))
    words = [r[1].split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    kept = {r.doc_id for r in simhash.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, parent = 0, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) <= 1.26 * len(sets[j]) and len(sets[j]) <= 1.26 * len(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += rows[i][0] % 20 == 0 or rows[j][0] % 20 == 0
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert len(rows) > 1000 and links > 40
    assert kept == {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_similarity():
    assert simhash.similarity("A b c d e f", "a B c d e g", 5) == 1 / 3
    assert simhash.similarity(None, " ", 5) == 1.0 and simhash.similarity("a", None, 5) == 0.0


def test_stages_against_brute_force(spark):
    rows, exact, near, junk = corpus(2, 60)
    docs = spark.createDataFrame(rows + exact + near + junk, SCHEMA)
    scratch = Scratch(spark, "t")
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5 and C.ORACLE_SQL is None
    steps = [docs]
    for name, stage in C.STAGES:
        steps.append(scratch.save(stage(spark, steps[-1], ""), name))
    assert all(s.columns == docs.columns for s in steps[:-1])
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    assert ids[1] == sorted(r[0] for r in rows + exact + near + junk[3:])
    last = {}
    for r in rows + exact + near + junk[3:]:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    assert ids[2] == sorted(last.values())
    texts = {r[0]: r[1] for r in rows + exact + near + junk}
    # one of each family stays: the copies share an origin
    family = lambda i: i % 60 if i < 9000 else i
    families = [family(i) for i in ids[3]]
    assert set(families) == {family(i) for i in ids[2]} and len(families) == len(set(families))
    copies = {r.doc_id: r.copies for r in mixing.mix(spark, steps[3]).collect()}
    assert ids[4] == sorted(i for i, c in copies.items() for _ in range(c))
    packed = steps[5].collect()
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [a + b for a, b in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    encode = packing.WordTokenizer.of(packing.tokenizer_path()).encode
    total = sum(len(np.frombuffer(encode(texts[i]), "<u4")) + 1 for i in ids[4])
    assert sum(r.length for r in packed) == total


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
