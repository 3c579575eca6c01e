"""Line deduplication by a segment-partition edit join.

The unit of an edit is a word: one word inserted, deleted or replaced. A line with a word goes if an
equal line stands in a document of lower id or earlier in its own, or if some line of lower hash is
near it. How many edits are near depends on the shorter of two lines: `EDITS` from `NEAR_WORDS` words
on, one from `SHORT_WORDS` words on, none below, where one edit would be a third of the line or more.

For a threshold of E edits, a line of L words is cut into E + 1 segments. Two lines within the
threshold share one of them, at a place that the lengths narrow down: for two edits to five
substrings for equal lengths, four and three for one and two words more, for one edit to two and two.
These twelve or four substrings, keyed by length, segment and content, are the buckets of a join; lines
of exactly `NEAR_WORDS` words stand in both joins, so that shorter ones meet them. `pivots` compares
the members of a bucket, and the distance is a banded bit-parallel one over many pairs at once. Lines
that no pivot reaches are first screened by bit sketches of their words: an edit takes at most one word
out and brings at most one in. Equal lines of any texts are one member of a bucket, so groups of copies never meet each other.

Texts pass once for keys, and once for the words of long lines that share a bucket; the lines are picked
by a bitmap of fixed size, which only saves work. Words of short lines go with their keys. Ids of lines are 64-bit hashes.

Cases: null texts stay null; blank lines stay; null ids count as the lowest id; rows equal in id
and text are treated alike; rows of one id never cost each other a line; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.bitmaps import id_bitmap, in_bitmap
from gridwake.llm.pivots import bucket_links
from gridwake.llm.shingling import Spans, mix, row_blocks, words_of
from gridwake.llm.words import let
from gridwake.session import stage

EDITS = 2
SHORT_EDITS = 1
SHORT_WORDS = 4
NEAR_WORDS = 10
#: 64-bit numbers in the sketch of a long or a short line's words; the number of bits set and the number of words follow them.
SKETCH = 8
SHORT_SKETCH = 4
_LOWEST = -(1 << 63)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(words the other line is shorter, segment, shift of the substring): all places where an intact segment can stand."""
    return [
        (d, i, s)
        for d in range(edits + 1)
        for i in range(edits + 1)
        for s in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)
    ]


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment `i`; the last ones take the odd words."""
    parts = edits + 1
    base, odd = length // parts, length % parts
    longer = np.maximum(0, i - (parts - odd))
    return base * i + longer, base + (i >= parts - odd)


def segment_keys(spans: Spans, first: np.ndarray, count: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """One row of bucket keys per line."""
    places = probes(edits)
    out = np.empty((len(first), len(places)), np.uint64)
    for k, (shorter, i, shift) in enumerate(places):
        other = count - shorter
        start, size = _segment(other, i, edits)
        at = first + np.clip(start + shift, 0, count - size)
        out[:, k] = mix(spans(at, at + size) ^ mix(other.astype(np.uint64) * np.uint64(8) + np.uint64(i)))
    return out


def _lines(data: np.ndarray, at: np.ndarray):
    """Spans over the words of a block, and per line with words: row, number in the row, first word, words, hash."""
    starts, words = words_of(data, at)
    row = np.searchsorted(at, starts, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    number = breaks[starts] - breaks[at[row]]
    change = np.ones(len(starts), bool)
    change[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(starts)))
    spans = Spans(words)
    return spans, words, row[first], number[first], first, count, spans(first, first + count)


def _lists(values: np.ndarray, on: np.ndarray) -> pa.Array:
    """A list per row: the next row of `values` where `on`, else empty."""
    ends = np.concatenate([[0], np.cumsum(np.where(on, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64)))


def _words(words: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
    """Per line its words as 32-bit hashes, and which of 64 * `size` bits they fall on, with the numbers of bits and words."""
    codes = (words >> np.uint64(32)).astype("<u4")
    parts = [codes[f : f + n] for f, n in zip(first.tolist(), count.tolist())]
    bits = np.zeros((len(first), size), np.uint64)
    place = np.concatenate(parts or [codes[:0]]).astype(np.int64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(first)), count), (place >> 6) % size), np.uint64(1) << (place & 63).astype(np.uint64))
    return [p.tobytes() for p in parts], np.column_stack([bits, np.bitwise_count(bits).sum(axis=1).astype(np.uint64), count.astype(np.uint64)])


_KEYS = "id long, text_key long, line int, hash long, again boolean, keys array<long>, short_keys array<long>, data binary, sketch array<long>"


def line_keys(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row per line with a word, with its bucket keys where it may have near lines; `data` and `sketch` only of lines with `short_keys`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys_of_text, done = batch.column(0), batch.column(1), 0
            for data, at in row_blocks(batch.column(2)):
                if len(data):
                    spans, words, row, number, first, count, hashes = _lines(data, at)
                    order = np.lexsort((number, hashes, row))
                    again = np.zeros(len(row), bool)
                    a, b = order[:-1], order[1:]
                    again[b] = (row[a] == row[b]) & (hashes[a] == hashes[b])
                    fresh = np.zeros(len(row), bool)  # equal lines have equal keys, which one of them in a block gives
                    fresh[np.unique(hashes, return_index=True)[1]] = True
                    near = (count >= NEAR_WORDS) & fresh
                    short = (count >= SHORT_WORDS) & (count <= NEAR_WORDS) & fresh
                    coded, sketches = _words(words, first[short], count[short], SHORT_SKETCH)
                    held = np.full(len(row), None, object)
                    held[short] = coded
                    pick = pa.array(row + done)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pick), keys_of_text.take(pick), pa.array(number.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(again),
                            _lists(segment_keys(spans, first[near], count[near]), near),
                            _lists(segment_keys(spans, first[short], count[short], SHORT_EDITS), short),
                            pa.array(held, pa.binary()), _lists(sketches, short),
                        ],
                        ["id", "text_key", "line", "hash", "again", "keys", "short_keys", "data", "sketch"],
                    )
                done += len(at) - 1

    return _keyed(docs, id_col, text).mapInArrow(emit, _KEYS)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("t"))


def line_words(docs: DataFrame, bitmap: np.ndarray, text: str) -> DataFrame:
    """`id, data, sketch`: the words, as 32-bit hashes, of lines whose bit is set, and which of 64 * `SKETCH` bits they fall on; one row per line hash."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at in row_blocks(batch.column(0)):
                if len(data):
                    _, words, _, _, first, count, hashes = _lines(data, at)
                    use = np.flatnonzero(in_bitmap(shared.value, hashes) & (count >= NEAR_WORDS))
                    use = use[np.unique(hashes[use], return_index=True)[1]]
                    rows, bits_of = _words(words, first[use], count[use], SKETCH)
                    sketches = pa.FixedSizeListArray.from_arrays(pa.array(bits_of.ravel().view(np.int64)), SKETCH + 2).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[use].view(np.int64)), pa.array(rows, pa.binary()), sketches], ["id", "data", "sketch"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(emit, "id long, data binary, sketch array<long>").dropDuplicates(["id"])


def banded_distances(xs: list[np.ndarray], ys: list[np.ndarray], most: int = 2 * EDITS) -> np.ndarray:
    """Edit distances of many pairs up to `most`, and `most + 1` beyond; sequences longer than `most`.

    Each pair's band of `2 * most + 1` rows lies in the top bits of one 64-bit word; a column of all
    pairs is one step.
    """
    out = np.full(len(xs), most + 1, np.int64)
    fits = [k for k in range(len(xs)) if abs(len(xs[k]) - len(ys[k])) <= most]
    fits.sort(key=lambda k: len(xs[k]))
    first = 0
    while first < len(fits):
        last, widest = first, 0
        while last < len(fits) and (last == first or (last - first + 1) * max(widest, len(xs[fits[last]]), len(ys[fits[last]])) <= 2_000_000):
            widest = max(widest, len(xs[fits[last]]), len(ys[fits[last]]))
            last += 1
        part = fits[first:last]
        out[part] = _band([xs[k] for k in part], [ys[k] for k in part], most)
        first = last
    return out


def _band(xs: list[np.ndarray], ys: list[np.ndarray], most: int) -> np.ndarray:
    m, n = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    width, size = 2 * most + 1, int(n.max())
    # codes are shifted by one, so that 0 in the padding of x meets no word and no padding of y
    x = np.zeros((len(xs), most + max(int(m.max()), size) + width), np.int64)
    y = np.full((len(ys), size), -1, np.int64)
    for k, (a, b) in enumerate(zip(xs, ys)):
        x[k, most : most + len(a)] = a.astype(np.int64) + 1
        y[k, : len(b)] = b.astype(np.int64) + 1
    one, top = np.uint64(1), np.uint64(63)
    weights = one << np.arange(63 - width + 1, 64, dtype=np.uint64)
    vp = np.full(len(xs), ~np.uint64(0) << np.uint64(63 - most), np.uint64)
    vn = np.zeros(len(xs), np.uint64)
    score = np.full(len(xs), most, np.int64)
    for i in range(size):
        match = ((x[:, i : i + width] == y[:, i][:, None]) * weights).sum(axis=1, dtype=np.uint64)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        slide = i < m - most  # the band's last row still moves down; afterwards the last word's row moves up in it
        place = np.clip(62 - (i - (m - most)), 0, 63).astype(np.uint64)
        diagonal = 1 - ((d0 >> top) & one).astype(np.int64)
        level = ((hp >> place) & one).astype(np.int64) - ((hn >> place) & one).astype(np.int64)
        score += np.where(i < n, np.where(slide, diagonal, level), 0)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return np.minimum(score, most + 1)


def near_lines(docs: DataFrame, lines: DataFrame, text: str) -> DataFrame:
    """`hash` of every line that has a line of lower hash within the threshold of the shorter one."""

    def long_words(ids: DataFrame) -> DataFrame:
        return stage(line_words(docs, id_bitmap(ids), text))

    def short_words(ids: DataFrame) -> DataFrame:
        held = lines.filter("data is not null").select(F.col("hash").alias("id"), "data", "sketch")
        return stage(held.join(ids, "id", "left_semi").dropDuplicates(["id"]))

    def found(keys: str, payload: Callable[[DataFrame], DataFrame], edits: int, size: int) -> DataFrame:
        @F.pandas_udf("double")
        def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for xs, ys in batches:
                yield pd.Series(banded_distances([np.frombuffer(x, "<u4") for x in xs], [np.frombuffer(y, "<u4") for y in ys], 2 * edits), dtype=float)

        def screen(a: Column, b: Column) -> Column:
            of = lambda x, k: F.get(x, F.lit(k))
            each = [F.bit_count(of(a, k).bitwiseAND(of(b, k))) for k in range(size)]
            return (F.abs(of(a, size + 1) - of(b, size + 1)) <= edits) & (sum(each[1:], each[0]) >= F.greatest(of(a, size), of(b, size)) - edits)

        members = lines.select(F.explode(keys).alias("bucket"), F.col("hash").alias("id"))
        return bucket_links(members, payload, distance, edits, screen=screen).select(F.col("b").alias("hash"))

    return found("keys", long_words, EDITS, SKETCH).union(found("short_keys", short_words, SHORT_EDITS, SHORT_SKETCH)).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, text_key, lines`: numbers of the lines that go, for rows that lose some."""
    lines = stage(line_keys(docs, id_col, text))
    once = lines.filter(~F.col("again"))
    twice = once.groupBy("hash").agg(F.min("id").alias("home"), F.max("id").alias("_last")).filter("home < _last").select("hash", "home")
    near = stage(near_lines(docs, lines, text)).withColumn("near", F.lit(True))
    verdict = twice.join(near, "hash", "full")
    gone = once.select("id", "text_key", "line", "hash").join(verdict, "hash").filter(F.coalesce("near", F.lit(False)) | (F.col("id") != F.col("home")))
    every = gone.select("id", "text_key", "line").union(lines.filter("again").select("id", "text_key", "line"))
    return every.groupBy("id", "text_key").agg(F.collect_set("line").alias("lines"))  # at most the lines of one text


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with the remaining lines as text; `count` names a column for the number of lines gone."""
    gone = dropped_lines(docs, id_col, text).withColumnsRenamed({"id": "__id", "text_key": "__key", "lines": "__gone"})
    here = F.coalesce(F.col(f"d.`{id_col}`").cast("long"), F.lit(_LOWEST))
    joined = docs.withColumn("__text_key", F.xxhash64(f"`{text}`")).alias("d").join(gone.alias("g"), (here == F.col("g.__id")) & (F.col("d.__text_key") == F.col("g.__key")), "left")

    def rest(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    kept = let(F.split(F.col(f"`{text}`"), "\n"), rest)
    out = joined.withColumn("__new", F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept))
    names = [F.col("__new").alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    if count:
        names.append(F.coalesce(F.size(F.col("__gone")), F.lit(0)).cast("long").alias(count))
    return out.select(*names)
