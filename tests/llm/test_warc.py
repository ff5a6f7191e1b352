"""WARC files: what is written is what is read."""

import hashlib
import itertools

import pytest

from vellum.llm import scratch, warc


def round_trip(spark, rows, size):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk int")
    path = f"{scratch.shared_dir(spark)}/warc"
    warc.write(pages, path, size)
    return warc.read(spark, path, size), path


def test_round_trip(spark):
    long = "line one\r\nline two\n\nWARC/1.1\r\n\r\n" * 40
    rows = [
        (1, "http://a\r\nb", long, 0), (2, None, long, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "small", 0),
        (6, "u", "small", 0), (7, "u", "é" * 500, 0), (7, "u", "é" * 500, 0), (8, "u", "x" * 64, 1), (9, "u", "x" * 128, 1),
        (10, "u", "x" * 128, 1), (11, "u", "\r\n\r\n", 1), (12, "u", "y" * 100 + "\n", 1),
    ]
    chunks, _ = round_trip(spark, rows, 64)
    got = chunks.collect()
    assert max(len(r.bytes) for r in got) <= 64
    by_id = {}
    for r in sorted(got, key=lambda r: r.chunk):
        by_id.setdefault(r.record_id, []).append(bytes(r.bytes))
    assert b"".join(by_id["1"]).decode() == long
    assert b"".join(by_id["9"]) == b"x" * 128
    out = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.records(chunks).collect())
    first = {}
    want = []
    for k, _, html, _ in sorted(rows, key=lambda r: r[0]):
        b = (html or "").encode()
        ref = first.setdefault(b, k) if len(b) >= 100 else k
        want.append((str(k), "revisit" if ref != k else "response", str(ref) if ref != k else None, len(b), hashlib.sha256(b).hexdigest()))
    assert out == sorted(want, key=lambda r: (r[0], r[1]))
    assert all(r.intact for r in warc.records(chunks).collect())


def test_segments_are_records(spark):
    _, path = round_trip(spark, [(1, "u", "z" * 1000, 0)], 300)
    text = b"".join(bytes(r[0]) + b"\n" for r in spark.read.option("lineSep", "\n").text(path).selectExpr("cast(value as binary)").collect())
    assert text.count(b"WARC-Type: continuation\r\n") == 3 and b"WARC-Segment-Total-Length: 1000\r\n" in text
    assert text.endswith(b"\r\n\r\n")


def test_empty(spark):
    chunks, _ = round_trip(spark, [], 64)
    assert warc.records(chunks).count() == 0


def parsed(raw: bytes, size: int = 64) -> list[tuple]:
    """The chunk rows of an archive's bytes."""
    parser = warc.Records(size)
    lines = raw.split(b"\n")
    out = list(itertools.chain.from_iterable(parser.feed(line + b"\n") for line in (lines if lines[-1] else lines[:-1])))
    parser.finish("here")
    return out


def record(name: str, payload: bytes, *more: str) -> bytes:
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: {name}", *more, f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_foreign_archive_and_truncation():
    each = [record("<urn:uuid:1>", b"a\nb\r\nc"), record("<urn:uuid:2>", b""), record("<urn:record:7>", b"d" * 200 + b"\n")]
    rows = parsed(b"".join(each))
    assert [(r[0], r[10]) for r in rows if r[12]] == [("<urn:uuid:1>", 6), ("<urn:uuid:2>", 0), ("7", 201)]
    assert b"".join(r[9] for r in rows if r[0] == "7") == b"d" * 200 + b"\n"
    for one in each:
        for cut in range(1, len(one) - 4):  # the last four bytes only close the record
            with pytest.raises(ValueError):
                parsed(each[0] + one[:cut])


def test_segments_must_follow():
    first = record("<urn:record:1>", b"x" * 10, "WARC-Segment-Number: 1")
    last = record("<urn:record:1:1>", b"y" * 5, "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 15")
    assert [r[10] for r in parsed(first + last) if r[12]] == [15]
    for bad in (first, last, first + record("<urn:record:2>", b"z")):
        with pytest.raises(ValueError):
            parsed(bad)
    with pytest.raises(ValueError):
        parsed(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n")


def test_split_archive_fails(spark):
    path = f"{scratch.shared_dir(spark)}/plain"
    text = "".join(record(f"<urn:record:{k}>", b"text " * 50).decode() for k in range(400))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
    assert warc.records(warc.read(spark, path)).count() == 400
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with pytest.raises(Exception, match="dealt out in blocks"):
            warc.records(warc.read(spark, path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
