import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"


def brute_phrases(text, training, block):
    total = 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in training and part[i:j] in training:
                j += 1
            total += 1
            i = j
    return total


def close(found, want, blocks):
    # an end of a block, or an unknown letter next to a phrase, may count one phrase more
    return abs(found - want) <= blocks


def test_phrases_match_brute_force(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 40)
    rng = random.Random(1)
    texts = {"a": "".join(rng.choice("abc ") for _ in range(300)), "b": "".join(rng.choice("bcd ") for _ in range(300))}
    model = L.Model(texts)
    queries = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 150))) for _ in range(60)] + ["a", "zzz", "azb"]
    got = model.phrases(queries)
    for q, row in zip(queries, got.tolist()):
        for name, found in zip(model.names, row):
            assert close(found, brute_phrases(q, texts[name], 40), -(-len(q) // 40) + q.count("z")), (q, name)


def test_automaton_knows_substrings_alone():
    rng = random.Random(2)
    seq = [rng.randint(1, 3) for _ in range(60)]
    edges = L.automaton(seq)
    packed = L.Packed(edges, 5)
    have = {tuple(seq[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    for _ in range(2000):
        word = tuple(rng.randint(1, 4) for _ in range(rng.randint(1, 6)))
        state = 1
        for c in word:
            assert packed.step(np.array([state]), np.array([c]))[0] == edges[state].get(c, 0)
            state = edges[state].get(c, 0)
            if not state:
                break
        assert bool(state) == (word in have)


def test_letters_of_any_script_count(spark):
    texts = {"x": "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "y": "".join(map(chr, range(0x10400, 0x10428)))}
    model = L.Model(texts)
    assert model.predict([texts["x"][100:160], texts["y"][5:20].lower(), "plain"])[0][0] == "x"
    assert model.phrases([L.cleaned(texts["x"])]).tolist()[0][0] == 1


def test_texts_of_no_language_go(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(80)), "en", "") for i in range(60)]
    junk = [(100 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80)), None, "") for i in range(20)]
    short = [(200, "qx", None, "")]
    kept = {r.doc_id for r in L.accepted(spark, spark.createDataFrame(clean + junk + short, SCHEMA)).collect()}
    assert kept == {r[0] for r in clean + short}


def test_training_rows_are_bounded(spark):
    rows = [(None, f"words of row {'abcdefghij'[i % 10] * (1 + i // 1000)}", "en", "") for i in range(20000)] + [(8, "one repeated row", "fr", "")] * 20000 + [(9, "w " * 9000, "de", "")]
    texts = L.training_texts(spark.createDataFrame(rows, SCHEMA), rows=10)
    assert sorted(texts) == ["de", "en", "fr"] and texts["fr"] == "one repeated row" and texts["en"].count("words") == 10
    assert set(texts["de"].split()) == {"w"} and len(texts["de"]) <= 18000
    assert len(L.training_texts(spark.createDataFrame([(i, "text", f"l{i}", "") for i in range(40)], SCHEMA), languages=5)) == 5


def test_letters_are_shared_by_languages(spark):
    rows = [(i, f"{'abcdefgh'[i % 8]} " * (300 + i), f"l{i % 8}", "") for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    full = L.training_texts(docs, rows=10, chars=3000)
    some = L.training_texts(docs, rows=10, chars=3000, letters=8 * 5000)
    assert sorted(full) == sorted(some) == [f"l{k}" for k in range(8)]
    assert all(0 < len(some[k]) <= 5000 < len(full[k]) and full[k].startswith(some[k]) for k in some)
    assert all(0 < len(t) <= 3000 for t in L.training_texts(docs, rows=10, chars=3000, letters=1).values())


def test_language_of_long_texts_only(spark):
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(k) for _ in range(rng.randint(2, 6))) for _ in range(60)] for k in ("abcd", "mnop")}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, text("abcd", 30), "short", "") for i in range(40)] + [(100 + 4 * i, text("mnop", 3000 + 100 * i), "long", "") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = L.training_texts(docs, rows=4, chars=500)
    assert sorted(texts) == ["long", "short"] and 500 < len(texts["long"]) <= 4 * 501
    assert texts == L.training_texts(docs.repartition(7), rows=4, chars=500)
    assert sorted(L.training_texts(docs.filter("lang = 'long'"), rows=4, chars=500)) == ["long"]
    model = L.Model(texts)
    assert model.predict([text("mnop", 50), text("abcd", 50)])[0] == ["long", "short"]


def test_tables_side_by_side_step_as_each_alone():
    rng = random.Random(6)
    parts = [L.Packed(L.automaton([rng.randint(1, 4) for _ in range(n)]), 6) for n in (50, 1, 80)]
    whole, moved = L.Packed.side_by_side(iter(parts))
    for part, by in zip(parts, moved):
        for state in range(1, len(part.base)):
            for c in range(6):
                alone, beside = (int(p.step(np.array([s]), np.array([c]))[0]) for p, s in ((part, state), (whole, state + by)))
                assert beside == (alone + by if alone else 0)


def test_undetermined_and_long(spark):
    rows = [(1, None, None, ""), (2, "", "x", ""), (3, " 12 .!? _ \n", "x", ""), (4, "the cat and the dog", "en", ""), (5, "der hund und die katze", "de", ""), (6, "the dog and the cat " * 4000, None, ""), (7, "…日本語…", None, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in L.identify(docs, {"en": "the cat and the dog were there and the end", "de": "der hund und die katze sind da und das ende"}).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == got[6].lang_pred == "en" and got[5].lang_pred == "de" and got[7].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.identify(docs.limit(0), {"en": "a"}).count() == 0


def test_fold_is_crc32(spark):
    ids = list(range(200)) + [-5, 1 << 40]
    got = {r.i: r.f for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", L.fold("i").alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in ids}


def test_learns_outside_the_fold_only(spark):
    rows = [(i, f"secret{'x' * (i % 5)}" if zlib.crc32(str(i).encode()) % 4 == 2 else "open words here", "en" if i % 2 else None, "") for i in range(300)]
    texts = L.training_texts(spark.createDataFrame(rows, SCHEMA), rows=20)
    assert list(texts) == ["en"] and "secret" not in texts["en"] and 1 <= texts["en"].count("open") <= 20
    assert L.training_texts(spark.createDataFrame([], SCHEMA)) == {}


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = L.training_texts(docs)
    assert texts == L.training_texts(docs.repartition(5))
    got = L.identify(docs, texts).join(docs.select("doc_id", "lang"), "doc_id").filter(L.fold() == L.HELD_OUT)
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_accepted_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "en", "s"), (2, None, "en", "s"), (3, "42", "en", "s"), (4, "ein text", None, None)], SCHEMA)
    out = L.accepted(spark, docs)
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == [1, 4]
