"""Web archives of Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Writing. Rows get the SHA-1 and length of their payload; of rows with equal payloads of at least
`REVISIT_BYTES` the one with the largest id becomes a response and the others revisit it. Groups
are counted with a map-side combine, and the join that tells each row its group is dealt by payload
digest and a salt, so a page with a third of all rows spreads over `SALTS` keys at least. Each task
then packs its records into archives of about `ARCHIVE_BYTES`; an archive trains its own dictionary
on its first records (at most `TRAIN_RECORDS` and `TRAIN_BYTES`; it changes sizes, no result) and
travels as one row, which Spark's text writer puts into a file of its own through the cluster's file
system and commit protocol. The writer's line end is an empty skippable frame, which every
Zstandard reader passes over.

Reading. Each archive is one row of the binary-file source (so an archive must stay below 2 GB).
The dictionary comes from the leading skippable frame, each further frame is cut out by its block
headers and decoded on its own. Checked are frame checksum and stated size, version line, required
fields, block length against `Content-Length`, the closing blank lines, that nothing follows, the
payload's length against its HTTP header and its digest against the record's. A record that fails
ends the job, or becomes a row with `problem` when `strict` is off.

Cases: a null html is an empty payload; a null id is no target while its group has another, writes
no id field and reads back null; rows repeated under the largest id are all responses; a null url
writes no target field; control characters in a url are percent-encoded; very long payloads are
written whole; an empty table writes and reads no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
SALTS = 16
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES, TRAIN_RECORDS, TRAIN_BYTES = 16 << 10, 128, 1 << 20
#: Rows and bytes of payload that the reader hands over at once.
READ_ROWS, READ_BYTES = 2048, 8 << 20

#: Magic numbers of frames, the skippable frame of a dictionary, and the revisit profile.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = range(0x184D2A50, 0x184D2A60)
DICTIONARY_MAGIC = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: A skippable frame without content; printable, so it can be the line end of a text file.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"


class ArchiveError(ValueError):
    """A frame or record that breaks the format."""


def described(pages: DataFrame) -> DataFrame:
    """`page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to` of each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    large = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    same = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
    same = same.filter((F.col("n") > 1) & F.col("target").isNotNull()).select("payload_digest", "payload_bytes", "target", salts)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return rows.join(same, ["payload_digest", "payload_bytes", "salt"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("target")).alias("refers_to"),
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, digest if page_id is None else str(page_id)).urn}>"


def build_record(row: dict, date: str) -> bytes:
    """One record: its fields, a blank line, the HTTP block, two line ends."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"], row["payload_digest"])), ("WARC-Date", date)]
    if row["page_id"] is not None:
        fields.append(("Page-Id", row["page_id"]))
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), row["url"])))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id(row["refers_to"], "")), ("Refers-To-Page-Id", row["refers_to"])]
    else:
        block += row["payload"]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from the records; their plain end where they are too few to train one."""
    samples = [r[:TRAIN_BYTES] for r in records]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _archives(rows: Iterator[dict], date: str, size: int) -> Iterator[bytes]:
    """Archives of the rows, each closed once it has `size` bytes."""
    waiting: list[bytes] = []
    archive, packer = bytearray(), None

    def start() -> None:
        nonlocal packer
        words = train(waiting)
        archive.extend(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
        for record in waiting:
            archive.extend(packer.compress(record))
        waiting.clear()

    held = 0
    for row in rows:
        record = build_record(row, date)
        if packer is None:
            waiting.append(record)
            held += len(record)
            if len(waiting) >= TRAIN_RECORDS or held >= TRAIN_BYTES:
                start()
        else:
            archive.extend(packer.compress(record))
        if len(archive) >= size:
            yield bytes(archive)
            archive, packer, held = bytearray(), None, 0
    if waiting:
        start()
    if archive:
        yield bytes(archive)


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", size: int = ARCHIVE_BYTES) -> None:
    """Write `described` rows to archive files below `path`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in range(0, batch.num_rows, 256) for row in batch.slice(part, 256).to_pylist())
        for archive in _archives(rows, date, size):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["value"])

    packed = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def _frame_end(data: memoryview, at: int) -> int:
    """End of the frame at `at`, by its block headers."""
    head = data[at : at + 18]
    end = at + zstandard.frame_header_size(head)
    while True:
        if end + 3 > len(data):
            raise ArchiveError("frame is cut off")
        word = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)  # a run-length block holds one byte
        if word & 1:
            break
    end += 4 * zstandard.get_frame_parameters(head).has_checksum
    if end > len(data):
        raise ArchiveError("frame is cut off")
    return end


def frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """Place and decoded content of each frame of an archive."""
    at, unpacker, first = 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError(f"byte {at}: no frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE_MAGIC:
            body = bytes(data[at + 8 : at + 8 + size])
            if len(body) != size:
                raise ArchiveError(f"byte {at}: frame is cut off")
            if first and magic == DICTIONARY_MAGIC:
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            try:
                end = _frame_end(data, at)
                stated = zstandard.get_frame_parameters(data[at : at + 18]).content_size
                if stated in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR):
                    content = unpacker.decompressobj().decompress(data[at:end])
                else:
                    content = unpacker.decompress(data[at:end])
                    if len(content) != stated:
                        raise ArchiveError("content is not as long as stated")
            except (zstandard.ZstdError, ArchiveError) as error:
                raise ArchiveError(f"byte {at}: {error}") from error
            yield at, content
            at = end
        else:
            raise ArchiveError(f"byte {at}: no frame")
        first = False


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise ArchiveError(what)


def _fields(lines: list[str]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        _need(bool(colon) and bool(name) and name == name.strip(), f"bad field {line[:60]!r}")
        fields[name.lower()] = value.strip(" \t")
    return fields


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name.lower())
    _need(value is None or re.fullmatch(r"-?\d+", value) is not None, f"{name} is no number")
    return None if value is None else int(value)


def parse_record(content: bytes, payloads: bool = True) -> dict:
    """Check one record and return its row."""
    head, blank, rest = content.partition(b"\r\n\r\n")
    _need(bool(blank), "no end of the fields")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    _need(version in ("WARC/1.0", "WARC/1.1"), f"bad version line {version[:20]!r}")
    fields = _fields(lines)
    for name in REQUIRED:
        _need(bool(fields.get(name.lower())), f"no {name}")
    size = _number(fields, "Content-Length")
    block, end = rest[:size], rest[size:]
    _need(len(block) == size and end == b"\r\n\r\n", "block is not as long as Content-Length states, or more follows")
    kind = fields["warc-type"]
    _need(kind in ("response", "revisit"), f"unknown type {kind[:20]!r}")
    _need(kind == "response" or "warc-refers-to" in fields, "no WARC-Refers-To")
    http, blank, payload = block.partition(b"\r\n\r\n")
    _need(bool(blank) and http.startswith(b"HTTP/"), "no HTTP header")
    length = _number(_fields(http.decode("latin-1").split("\r\n")[1:]), "Content-Length")
    _need(length is not None and length >= 0, "no length of the payload")
    algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
    _need(algorithm == "sha1" and re.fullmatch("[A-Z2-7]{32}", value) is not None, "no SHA-1 of the payload")
    digest = base64.b32decode(value).hex()
    if kind == "response":
        _need(len(payload) == length, "payload is not as long as stated")
        _need(hashlib.sha1(payload).hexdigest() == digest, "payload has another digest")
    else:
        _need(not payload, "a revisit with a payload")
    return {
        "page_id": _number(fields, "Page-Id"), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": _number(fields, "Refers-To-Page-Id"), "payload": payload if payloads and kind == "response" else None, "problem": None,
    }


def _rows(data: memoryview, name: str, strict: bool, payloads: bool) -> Iterator[dict]:
    """Rows of one archive; a broken frame ends it, a broken record doesn't."""

    def broken(error: ArchiveError, at: str = "") -> dict:
        if strict:
            raise ArchiveError(f"{name}: {at}{error}") from error
        return {"problem": f"{name}: {at}{error}"}

    try:
        for at, content in frames(data):
            try:
                yield parse_record(content, payloads)
            except ArchiveError as error:
                yield broken(error, f"byte {at}: ")
    except ArchiveError as error:
        yield broken(error)


def read_archives(spark: SparkSession, path: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """Records of the archives below `path`; `payload` is null for revisits and where `payloads` is off."""
    names = [field.split()[0] for field in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(field.split()[0], types[field.split()[1]]) for field in RECORD.split(", ")])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                ready, held = [], 0
                for row in _rows(memoryview(content.as_buffer()), name.as_py(), strict, payloads):
                    ready.append({k: row.get(k) for k in names})
                    held += len(row.get("payload") or b"")
                    if len(ready) >= READ_ROWS or held >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(ready, schema)
                        ready, held = [], 0
                if ready:
                    yield pa.RecordBatch.from_pylist(ready, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, RECORD)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS target FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target > page_id THEN target END AS refers_to FROM t
"""
