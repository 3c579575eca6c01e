"""Annotation documents: JSON objects keyed by run."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.session import parallelism, stage
from gridwake.sources.ranges import Reader, file_ranges, list_files, rows_of

_ENTRY = "struct<annotations:array<struct<class:string,note:string,timestamp:string,ranges:array<string>>>>"


#: Bytes of a range of a document file.
RANGE = 8 << 20
#: Outside a string, inside one, and inside one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
_MARK = re.compile(rb'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\],]', re.S)
_REST = re.compile(rb'(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.S)
_DEPTH = {b"{": 1, b"[": 1, b"}": -1, b"]": -1}


def _closing(text: bytes) -> int:
    """State behind a (part of a) string that a scan ended."""
    quote = text.endswith(b'"')
    body = text[:-1] if quote else text
    odd = (len(body) - len(body.rstrip(b"\\"))) % 2
    if quote:
        return INSIDE if odd else OUTSIDE
    return ESCAPED if odd else INSIDE


def _marks(data: bytes, state: int) -> Iterator[tuple[int, bytes, int]]:
    """(place, bracket or comma, state behind it) outside strings, and last (length, b"", state at the end)."""
    at = 0
    if state == ESCAPED and data:
        at, state = 1, INSIDE
    if state == INSIDE and data:
        rest = _REST.match(data, at)
        state, at = _closing(data[at : rest.end()]) if rest.end() > at else INSIDE, rest.end()
        if at == len(data):
            yield at, b"", state
            return
    for m in _MARK.finditer(data, at):
        if data[m.start()] == 0x22:
            state = _closing(data[m.start() + 1 : m.end()])
        else:
            yield m.start(), m[0], OUTSIDE
    yield len(data), b"", state


def _summary(data: bytes, state: int) -> tuple[int, int, int]:
    """State at the end, change of depth, and least depth reached, of a range entered in `state` at depth 0."""
    depth = least = 0
    for _, mark, state in _marks(data, state):
        depth += _DEPTH.get(mark, 0)
        least = min(least, depth)
    return state, depth, least


def _entries(reader: Reader, path: str, start: int, size: int, state: int, depth: int, step: int) -> Iterator[bytes]:
    """Texts between separators of the outer object, for the separators in the range at `start`."""
    held: bytes | None = None
    first = True
    while first or (held is not None and start < size):
        data = reader.read(path, start, step)
        begin = 0
        for at, mark, state in _marks(data, state):
            depth += _DEPTH.get(mark, 0)
            if mark == b"," and depth == 1 or mark == b"}" and depth == 0:
                if held is not None:
                    yield held + data[begin:at]
                    held = None
                if not first:
                    return
            if first and (mark == b"," and depth == 1 or mark == b"{" and depth == 1):
                held, begin = b"", at + 1
        if held is not None:
            held += data[begin:]
        start, first = start + len(data), False


def outer_entries(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame:
    """`(path, entry)`: the text of each `"key": value` of the JSON object in each file; other text fails the job.

    A file is read in ranges by many tasks. Each range reports what it does to the scanner's state (in
    a string or not, depth) for every state it may be entered in; one row per range is put together in
    order; then each range cuts out the entries that begin in it and reads on to the end of the last.
    """
    ranges = file_ranges(list_files(spark, [path]), step)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Reader() as reader:
            for row in rows_of(batches):
                data = reader.read(row["path"], row["start"], step)
                head = data.lstrip()[:1]
                ends = [_summary(data, state) for state in (OUTSIDE, INSIDE, ESCAPED)]
                yield pa.RecordBatch.from_pylist([{**row, "head": head, "ends": [v for e in ends for v in e]}])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        state = depth = 0
        states, depths, began = [], [], False
        for head, ends in rows.sort_values("start")[["head", "ends"]].itertuples(index=False):
            if not began and head:
                began = True
                if head != b"{":
                    raise ValueError("annotations must be an object keyed by run")
            states.append(state)
            depths.append(depth)
            end, change, least = ends[3 * state : 3 * state + 3]
            if depth + least < 0:
                raise ValueError("a bracket closes that never opened")
            state, depth = int(end), depth + int(change)
        if state != OUTSIDE or depth:
            raise ValueError("document is cut off")
        return rows.sort_values("start")[["path", "size", "start"]].assign(state=states, depth=depths)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Reader() as reader:
            for row in rows_of(batches):
                found, held = [], 0
                for entry in _entries(reader, row["path"], row["start"], row["size"], row["state"], row["depth"], step):
                    if entry.strip():
                        found.append({"path": row["path"], "entry": entry.decode()})
                        held += len(entry)
                    if held >= step:
                        yield pa.RecordBatch.from_pylist(found)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found)

    known = stage(ranges.mapInArrow(summarise, "path string, size long, start long, head binary, ends array<long>"))
    placed = known.groupBy("path").applyInPandas(chain, "path string, size long, start long, state int, depth int")
    dealt = placed.repartition(parallelism(spark), "path", "start")
    return dealt.mapInArrow(cut, "path string, entry string")


def read_annotations(spark: SparkSession, path: str, lines: bool = False, step: int = RANGE) -> DataFrame:
    """`(run, document)` of every entry; text that is no JSON object fails the job.

    One object per file, read in ranges of `step` bytes, or with `lines` one per line.
    """
    if lines:
        raw = spark.read.text(path).filter(F.trim("value") != "")
        ok = F.trim("value").startswith("{")
        text = F.when(ok, F.col("value")).otherwise(F.raise_error(F.lit("annotations must be an object keyed by run")))
    else:
        raw, text = outer_entries(spark, path, step), F.concat(F.lit("{"), F.col("entry"), F.lit("}"))
    entries = F.from_json(text, "map<string,string>", {"mode": "FAILFAST"})
    return raw.select(F.explode(entries).alias("run", "document"))


def _annotations(docs: DataFrame) -> DataFrame:
    parsed = docs.select("run", F.from_json("document", _ENTRY).alias("d"))
    return parsed.select("run", F.posexplode("d.annotations").alias("annotation_index", "a"))


def _bounds(ranges):
    """Valid `(signal, start, end)` structs of an annotation; malformed entries are dropped."""
    groups = F.filter(F.transform(ranges, lambda g: F.from_json(g, "array<string>")), lambda g: g.isNotNull() & (F.size(g) == 2))

    def pairs(group):
        found = F.coalesce(F.from_json(F.get(group, F.lit(1)), "array<string>"), F.array().cast("array<string>"))
        parsed = F.transform(found, lambda b: F.from_json(b, "array<bigint>"))
        valid = F.filter(parsed, lambda b: b.isNotNull() & (F.size(b) == 2) & F.get(b, F.lit(0)).isNotNull() & F.get(b, F.lit(1)).isNotNull())
        return F.transform(
            valid,
            lambda b: F.struct(
                F.get(group, F.lit(0)).alias("signal"),
                F.array_min(b).alias("start_us"),
                F.array_max(b).alias("end_us"),
            ),
        )

    empty = F.array().cast("array<struct<signal:string,start_us:bigint,end_us:bigint>>")
    return F.coalesce(F.flatten(F.transform(groups, pairs)), empty)


def flatten_intervals(docs: DataFrame) -> DataFrame:
    """One row per valid range; reversed bounds are swapped."""
    a = _annotations(docs)
    return a.select("run", "annotation_index", F.coalesce("a.class", F.lit("")).alias("class"), F.explode(_bounds(F.col("a.ranges"))).alias("r")).select(
        "run", "annotation_index", "class", "r.*"
    )


def annotation_rows(docs: DataFrame) -> DataFrame:
    """As `flatten_intervals`, with note and time of the annotation, and one row without bounds for one that has no range."""
    a = _annotations(docs)
    rows = a.select(
        "run", "annotation_index", F.coalesce("a.class", F.lit("")).alias("class"), F.coalesce("a.note", F.lit("")).alias("note"), F.coalesce("a.timestamp", F.lit("")).alias("annotated_at"),
        F.posexplode_outer(_bounds(F.col("a.ranges"))).alias("range_index", "r"),
    )
    return rows.select("run", "annotation_index", "class", "note", "annotated_at", "range_index", "r.signal", "r.start_us", "r.end_us")
