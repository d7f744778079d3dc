import hashlib
import io
import struct

import pytest
from helpers import rows

from kvstrata.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, first string"


def expected(cases):
    first = {}
    for i, _, h in cases:
        p = (h or "").encode()
        if i is not None and len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, h in cases:
        p = (h or "").encode()
        f = first.get(p, i)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_round_trip(spark):
    long, odd = "ab" * 60, "WARC/1.1\r\n\r\n" * 20 + "é\x00"
    cases = [(3, "u", long), (1, "u\r\nWARC-Type: x", long), (9, None, long), (2, "u", "short"), (4, "u", "short"), (5, "ü", None), (6, "", ""), (7, "u", odd), (8, "u", odd), (None, "u", long), (None, "v", long), (None, None, None), (None, "w", "z" * 200), (None, "w", "z" * 200), (10, "u", "x" * 300_000), (1, "u", long)]
    cases += [(100 + i, "u", f"<html>{i}" + "<p>word " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame([(*c, "d", "f") for c in cases], SCHEMA)
    got = rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == expected(cases)
    assert warc.round_trip(df.limit(0)).count() == 0
    back = warc.read_archives(warc.write_archives(df, warc.shared_path(spark, "t")), with_payload=True)
    texts = {r.page_id: bytes(r.payload).decode() for r in back.collect() if r.payload is not None}
    assert texts[7] == odd and texts[1] == long and 3 not in texts


def test_pages(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    cases = [(r.page_id, r.url, r.html) for r in df.collect()]
    assert rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(cases)


def test_reader_checks():
    import zstandard

    samples = [f"<html><body>{i} some words of page {i * 7}</body></html>".encode() * 9 for i in range(200)]
    d = zstandard.train_dictionary(4096, samples).as_bytes()
    recs = [warc.record(i, "http://x/é y", s, hashlib.sha256(s).hexdigest(), None) for i, s in enumerate(samples)]
    out = io.BytesIO()
    warc.write_archive(out, iter(recs), d)
    raw = out.getvalue()
    assert struct.unpack("<II", raw[:8]) == (0x184D2A5D, len(d))
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(raw), chunk=7)] == samples
    packed = zstandard.ZstdCompressor().compress(d)  # the dictionary itself may be compressed
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + raw[8 + len(d) :]
    assert len(list(warc.read_archive(io.BytesIO(again)))) == 200
    for bad in (raw[:-3], raw[: 8 + len(d)] + b"xxxx" + raw[8 + len(d) :], raw[:100]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    good = recs[0]
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: ", b"Content-Length: 1"), good[:-1], good.replace(b"some", b"sOme"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)
