"""Archives: round trip, revisits against a plain rule, and every kind of damage."""

import hashlib
import struct

import pytest
import zstandard

from gridwake.llm import warc
from gridwake.session import shared_dir

PAGES = "page_id long, url string, html string, payload string"


def row(i, payload=b"<p>x</p>", kind="response", refers=None, url="http://a.example/1"):
    return {"page_id": i, "url": url, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "record_type": kind, "refers_to": refers}


def test_round_trip(spark):
    big, long = "ä" * 500, "<p>long</p>" * 300_000
    rows = [
        (1, "http://a.example/1", big, "x"), (2, "http://a.example/2", big, "x"), (9, "http://a.example/9", big, "x"), (9, "http://a.example/9", big, "x"),
        (3, None, big[:-1], "x"), (4, "", big[:-1], None), (5, "http://a.example/\r\nX: y", None, "x"), (6, "u", "", "x"), (None, "n", big, "x"),
        (None, "m", "z" * 1000, "x"), (None, "m", "z" * 1000, "x"), (7, "l", long, "x"), (8, "l", long, "x"), (-4, "k", "\r\n\r\n \x00 HTTP/1.1", "x"),
    ] + [(k, f"http://b.example/{k}", f"<p>page {k} of many alike</p>" * 9, "x") for k in range(100, 900)]
    pages = spark.createDataFrame(rows, PAGES)
    path = shared_dir(spark)
    warc.write_archives(warc.described(pages.repartition(3)), path, size=20_000)
    got = warc.read_archives(spark, path).collect()
    assert spark.read.format("binaryFile").load(path).count() > 3
    want = []
    for i, url, html, _ in rows:
        data = (html or "").encode()
        twins = [j for j, _, h, _ in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 1000 and bool(twins) and i != max(twins)
        url = url and url.replace("\r\n", "%0D%0A").replace(" ", "%20")
        want.append((i, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(twins) if again else None, None if again else data))
    key = lambda x: tuple(repr(v) for v in x)
    have = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {r.record_type for r in got if r.page_id == 3} == {"response"}  # 999 bytes


def test_empty_table(spark):
    path = shared_dir(spark)
    warc.write_archives(warc.described(spark.createDataFrame([], PAGES)), path)
    assert warc.read_archives(spark, path).count() == 0


def test_hot_payload_is_spread(spark):
    """One payload in most rows is dealt by many keys, not one."""
    pages = spark.range(3000).selectExpr("id page_id", "concat('http://h.example/', id) url", "repeat('hot ', 400) html", "'' payload")
    out = warc.described(pages)
    assert out.filter("record_type = 'revisit' and refers_to = 2999").count() == 2999
    salts = out.selectExpr("pmod(xxhash64(page_id, url), 16) salt").groupBy("salt").count().collect()
    assert len(salts) == warc.SALTS and max(r["count"] for r in salts) < 300


def read(data, **options):
    return list(warc._rows(memoryview(data), "a", options.get("strict", True), True))


def test_other_writers():
    """No dictionary, a packed dictionary, several blocks in a frame, further skippable frames, no stated size."""
    noise = b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(20_000))
    record = warc.build_record(row(1, noise), "2024-01-01T00:00:00Z")
    plain = zstandard.ZstdCompressor(write_checksum=True).compress(record)
    assert read(plain)[0]["payload"] == noise
    words = zstandard.ZstdCompressionDict(b"some raw words of a dictionary " * 9)
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    frame = zstandard.ZstdCompressor(dict_data=words, write_content_size=False).compress(record)
    pad = struct.pack("<II", 0x184D2A53, 3) + b"abc"
    assert [r["page_id"] for r in read(lead + pad + frame + pad + frame)] == [1, 1]
    runs = warc.build_record(row(2, b"a" * 500_000), "2024-01-01T00:00:00Z")
    assert read(zstandard.ZstdCompressor().compress(runs))[0]["payload_bytes"] == 500_000
    assert read(b"") == []


@pytest.mark.parametrize(
    "old, new",
    [
        (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Date", b"Other-Name"), (b"WARC-Record-ID", b"Some-Record-ID"),
        (b"<p>x</p>", b"<p>y</p>"), (b"<p>x</p>", b"<p>xx</p>"), (b"sha1:", b"md5:"), (b"Page-Id: 1", b"Page-Id: one"), (b"Page-Id: 1", b"no colon"),
        (b"</p>\r\n\r\n", b"</p>\r\n"), (b"</p>\r\n\r\n", b"</p>\r\n\r\nWARC/1.1"), (b"HTTP/1.1 200", b"GOPHER"), (b"charset=utf-8\r\nContent-Length", b"charset=utf-8\r\nX-Length"),
    ],
)
def test_broken_records(old, new):
    record = warc.build_record(row(1), "2024-01-01T00:00:00Z")
    broken = record.replace(old, new)
    assert broken != record
    good = zstandard.ZstdCompressor().compress(record)
    data = good + zstandard.ZstdCompressor().compress(broken) + good
    with pytest.raises(warc.ArchiveError):
        read(data)
    kept = read(data, strict=False)
    assert [r["problem"] is None for r in kept] == [True, False, True]


def test_broken_revisits():
    record = warc.build_record(row(1, b"", "revisit", 5), "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["refers_to"] == 5
    for old, new in [(b"WARC-Refers-To", b"X-Refers-To"), (b"\r\n\r\n\r\n\r\n", b"\r\n\r\nbody\r\n\r\n")]:
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(record.replace(old, new))


def test_broken_frames():
    record = warc.build_record(row(1), "2024-01-01T00:00:00Z")
    good = zstandard.ZstdCompressor(write_checksum=True).compress(record)
    flipped = bytearray(good)
    flipped[-1] ^= 1  # the checksum
    for data in (bytes(flipped), good[:-6], good + b"\x00" * 9, good + b"x", struct.pack("<II", warc.DICTIONARY_MAGIC, 99) + b"x"):
        with pytest.raises(warc.ArchiveError):
            read(data)
        assert read(data, strict=False)[-1]["problem"]
