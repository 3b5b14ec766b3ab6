import base64
import hashlib

import pytest
import zstandard

from millrace.llm import warc as W

RECORDS = [W.make_record(i, f"http://a.example/{i}?q=ü x", (f"<p>page {i}</p>" * (i * 7)).encode(), None) for i in range(120)] + [W.make_record(500, None, b"<p>page 3</p>" * 21, 3)]


@pytest.mark.parametrize("n", [1, 2, 121])
def test_archive_round_trip(n):
    data = W.write_archive(RECORDS[:n])
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    rows = list(W.read_archive(data))
    assert [r["page_id"] for r in rows] == [*range(120), 500][:n]
    if n == 121:
        assert rows[-1]["type"] == "revisit" and rows[-1]["refers_to"] == 3 and rows[-1]["payload_bytes"] == 13 * 21 and rows[-1]["digest"] == rows[3]["digest"]


def test_frames_are_one_a_record_and_need_the_dictionary():
    data = W.write_archive(RECORDS)
    assert list(W.frames(data)) == RECORDS
    size = int.from_bytes(data[4:8], "little")
    with pytest.raises(ValueError):
        list(W.frames(data[8 + size :]))


def test_plain_dictionary_and_other_skippable_frames():
    words = W.dictionary_of(RECORDS)
    press = zstandard.ZstdCompressor(dict_data=words)
    raw = words.as_bytes()
    other = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    data = b"\x5d\x2a\x4d\x18" + len(raw).to_bytes(4, "little") + raw + press.compress(RECORDS[0]) + other + press.compress(RECORDS[1])
    assert list(W.frames(data)) == RECORDS[:2]


def test_damage():
    data = W.write_archive(RECORDS[:5])
    for bad in (data[:-3], data[:5], data[:40], data + b"junk", data[:-20] + b"\xff" + data[-19:]):
        with pytest.raises(ValueError):
            list(W.read_archive(bad))
    good = RECORDS[5]
    for a, b in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Date", b"WARC-Dote"), (b"page 5", b"page 6"), (b"sha1:", b"sha2:"), (b"response", b"metadata"), (b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(ValueError):
            W.read_record(good.replace(a, b, 1))
    with pytest.raises(ValueError):
        W.read_record(good[:-2])


def brute(rows, least):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(p) >= least and first < i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 5])
def test_pages(spark, monkeypatch, least):
    rows = [(9, "http://x/", "same"), (4, None, "same"), (7, "u", None), (8, "u\r\nv", ""), (3, "u", "long " * 9000), (5, "u", "long " * 9000), (6, "ü", "é"), (6, "ü", "é")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    got = W.read(spark, W.archive(spark, df, least_bytes=least), payloads=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, least)
    assert all(bytes(r.payload) == next((h or "").encode() for i, _, h in rows if i == r.page_id) for r in got if r.record_type == "response")


def test_no_page_id_and_empty_table(spark):
    schema = "page_id long, url string, html string"
    got = W.read(spark, W.archive(spark, spark.createDataFrame([(None, "u", "a"), (None, "u", "a")], schema))).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(None, "response")] * 2
    assert W.read(spark, W.archive(spark, spark.createDataFrame([], schema))).count() == 0
