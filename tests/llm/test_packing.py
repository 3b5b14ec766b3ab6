import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing as P

PATH = P.tokenizer_path()
TEXTS = [None, "", " ", "a", "It's we'll 're DON'T x_y __ a1b22 3.5", "É Été ß ﬁ ² ½ İ ǅ Σς", "é ö", " a\u0085b​c", "<|endoftext|> a <|startoftext|>", "日本語 テスト 😀", "a\tb\r\nc\x0bd\x0ce\x1cf", "ªº µ ×÷ ¿¡", "word " * 5000]


def plain(text):
    return [*P.WordTokenizer.of(PATH).whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    alphabet = "abcXYZéÉßñÑçÇ'’_-.!?0 12\n\t<|>ÿŸıİǆ«»"
    for text in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(500)]:
        assert np.frombuffer(P.WordTokenizer.of(PATH).encode(text), "<u4").tolist() == plain(text)[:-1], repr(text)


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    t = P.WordTokenizer(PATH)
    for text in ("a b c d e", "f g h", "a b c d e"):
        assert np.frombuffer(t.encode(text), "<u4").tolist() == plain(text)[:-1]


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_uses_each_piece_once(counts):
    used, bins = {}, 0
    for times, bin_ in P.best_two_fit(counts, 50):
        assert sum(k * n for k, n in bin_) <= 50 and times > 0
        bins += times
        for k, n in bin_:
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert bins <= max(2 * -(-total // 50), 1)


def test_smallest_is_replaced_by_two():
    # greedy: 6 + 3, gap 1; 3 gives way to 2 + 2
    plan = P.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == (1, [(6, 1), (2, 2)]) and plan[1] == (1, [(3, 1)])
    assert P.best_two_fit({6: 1, 3: 1, 2: 1}, 10)[0] == (1, [(6, 1), (3, 1)])


def check(rows, docs, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = plain(text)
        mine = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == list(range(0, len(ids), size))
        for r in mine:
            part = ids[r.start : r.start + size]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [16, 2048])
def test_pack(spark, size):
    rng = random.Random(size)
    docs = list(enumerate(TEXTS + ["same text here"] * 50 + [" ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    n = check(P.pack(spark, df, PATH, size).collect(), docs, size)
    assert n <= 1.02 * -(-sum(len(plain(t)) for _, t in docs) // size) + 1


def test_empty_table(spark):
    assert P.pack(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
