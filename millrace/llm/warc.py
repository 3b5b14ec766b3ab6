"""WARC archives as Zstandard files with one frame a record and a dictionary in the first frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself maybe
Zstandard-compressed; each record is a frame of its own, compressed with that dictionary. The reader
walks the frames, decodes one record at a time, and checks the version line, the named headers, the
Content-Length against what follows, the closing blank lines and the payload digest.

Records of equal payloads are written once: the one of the smallest id as response, the others as
revisit records that name it. Which they are is found by SHA-256 and length, summed up before it moves,
so a payload that thousands of pages share isn't gathered in one task.

Archives are files in the shared folder. A task writes each under a name of its own attempt and returns
that name; only archives listed in the saved manifest are read, so repeated attempts do no harm.

Defined results: a null html is an empty payload; a null url is about:blank; a row without page_id is a
response; rows that repeat a page_id are written each, and those of the smallest id are all responses;
other columns are ignored; damage raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_BYTES = 16 << 10
#: Raw bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 8 << 20
CRLF = b"\r\n"
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response or, with `refers_to`, a revisit record. A revisit has the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    heads = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")),
        *([("X-Page-ID", str(page_id))] if page_id is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    heads.append(("Content-Length", str(len(block))))
    return VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in heads) + CRLF + block + CRLF + CRLF


def read_record(raw: bytes) -> dict:
    """type, page_id, payload_bytes, payload_digest, refers_to of a record; ValueError if it isn't sound."""
    head, found, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError("no WARC version line")
    named = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        named[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in named]:
        raise ValueError(f"headers missing: {missing}")
    if not named["content-length"].isdigit() or len(rest) != int(named["content-length"]) + 4 or rest[-4:] != CRLF + CRLF:
        raise ValueError("Content-Length doesn't fit the record")
    http, found, payload = rest[:-4].partition(CRLF + CRLF)
    status, *fields = http.split(CRLF)
    if not found or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    length = next((int(f.partition(b":")[2]) for f in fields if f.lower().startswith(b"content-length:")), -1)
    kind, said = named["warc-type"], named.get("warc-payload-digest", "")
    algorithm, _, said = said.partition(":")
    if algorithm != "sha1" or len(said) != 32:
        raise ValueError("no SHA-1 payload digest")
    if kind == "response":
        if len(payload) != length or digest(payload) != said:
            raise ValueError("the payload isn't what its length and digest say")
    elif kind != "revisit" or payload or "warc-refers-to" not in named or length < 0:
        raise ValueError("neither a response nor a sound revisit")
    page, refers = (int(named[k]) if k in named else None for k in ("x-page-id", "x-refers-to-page-id"))
    return {"page_id": page, "type": kind, "payload_bytes": length, "digest": said, "refers_to": refers, "payload": payload}


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for an archive, trained on its records' beginnings; where they are too few for that,
    those bytes themselves."""
    samples, size = [], 0
    for r in records:
        samples.append(r[:4096])
        size += len(samples[-1])
        if size >= 64 * DICTIONARY_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    words = dictionary_of(records)
    packed = zstandard.ZstdCompressor(level=9).compress(words.as_bytes())
    press = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed, *(press.compress(r) for r in records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each Zstandard frame, the dictionary of a leading skippable frame loaded."""
    at, words, view = 0, None, memoryview(data)
    press = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame ends early")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame ends early")
            if magic == DICTIONARY_MAGIC and at == 0:
                words = bytes(view[8 : 8 + size])
                if len(words) >= 4 and struct.unpack_from("<I", words)[0] == FRAME_MAGIC:
                    words = zstandard.ZstdDecompressor().decompress(words, max_output_size=64 << 20)
                press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else press
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("no Zstandard frame")
        one, parts = press.decompressobj(), []
        try:
            while not one.eof:
                part = bytes(view[at : at + (1 << 17)])
                if not part:
                    raise ValueError("a frame ends early")
                parts.append(one.decompress(part))
                at += len(part) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise ValueError(f"a damaged frame: {e}") from None
        yield b"".join(parts)


def read_archive(data: bytes) -> Iterator[dict]:
    return map(read_record, frames(data))


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes the pages to archives in the shared folder; returns the manifest: path, records, bytes."""
    scratch = scratch or Scratch(spark, "warc")
    folder = scratch.path("archives")
    raw = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(raw, 256).alias("key"), F.length(raw).alias("size"))
    first = rows.groupBy("key", "size").agg(F.min("page_id").alias("first"))
    again = (F.col("size") >= least_bytes) & (F.col("first") < F.col("page_id"))
    rows = rows.join(first, ["key", "size"]).select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(folder)
        disk.create_dir(top)

        def close(records: list[bytes]) -> tuple:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = write_archive(records)
            with disk.open_output_stream(f"{top}/{name}") as out:
                out.write(data)
            return f"{folder}/{name}", len(records), len(data)

        records, size, done = [], 0, []
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                records.append(make_record(page, url, (html or "").encode(), refers))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    done.append(close(records))
                    records, size = [], 0
        if records:
            done.append(close(records))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return scratch.save(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in `manifest` (path): page_id, payload_bytes, payload_digest,
    record_type, refers_to, and with `payloads` the payload of responses. One archive is held at a time;
    a count that differs from the manifest's raises ValueError."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["page_id", "payload_bytes", "digest", "type", "refers_to"] + ["payload"] * payloads
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for path, count in zip(*(c.to_pylist() for c in batch.columns)):
                disk, at = fs.FileSystem.from_uri(path)
                with disk.open_input_stream(at) as source:
                    rows = list(read_archive(source.read()))
                if len(rows) != count:
                    raise ValueError(f"{path}: {len(rows)} records, {count} written")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # one row an archive: dealt over the tasks by path
    listed = manifest.select("path", "records")
    return listed.repartition(max(1, min(1 << 16, listed.count())), "path").mapInArrow(scan, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, archive(spark, table(spark, sf_dir, "pages")))
