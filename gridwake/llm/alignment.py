"""Alignment of two tokenizers' tokens by their common byte offsets, and document counts of token links.

Each text is encoded by a byte-level BPE (A) and by a sentence-piece model (B), and each token gets
the byte offset of its end. The shorter end list drives a galloping search through the longer: from
the last hit the step doubles until it passes the wanted end, and binary search settles the place.
Ends found in both lists slice the tokens into groups; the difference of successive places is the
range of other tokens that a token overlaps, so its links follow without comparing tokens.

The number of documents that hold a link is a property of the whole corpus. Documents are packed
into chunks of about `CHUNK_LINKS` different links; a chunk lists its different id pairs once, with
their document counts, and its documents as places in that list. Only these lists are shuffled: the
counts are added up, the highest count of each A id is a window over the id's pairs (at most one per
B id), and each chunk gets the figures of its own list back. A pair that every document holds has
one row per chunk, so no key is hot, and what a task gathers is bounded by the chunk.

Cases: null and empty texts, and texts whose tokens don't give back the space and the text, have no
tokens, zeros and empty groups; special tokens inside texts are plain text; repeated rows count each
as a document; very long texts are encoded whole and may fill a chunk alone; an empty table gives an
empty table; other columns pass through, and an output column replaces one of its name.
"""

from __future__ import annotations

import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gridwake.llm.bpe import WORD_PATTERN, byte_alphabet
from gridwake.session import stage

#: Different links of a chunk, counted per document.
CHUNK_LINKS = 1 << 21
#: Texts encoded at a time.
TEXTS = 64
#: Characters of white space in a row from which a text goes to the slower encoder: the faster one's pattern engine overflows.
SPACE_RUN = 2000

ALIGNED = [
    ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()),
    ("pairs", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType())),
]
SCORED = [("n_best", T.LongType()), ("count_sum", T.LongType())]
EMPTY = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "pairs": [], "times": []}


class Pair:
    """Both tokenizers with the bytes and the decimal form of each of their tokens."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of = byte_alphabet()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for text, i in self.a.get_vocab().items():
            self.a_bytes[i] = text.encode() if i in special else bytes(byte_of[c] for c in text)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        # the same vocabulary by ranks (each merge has its product's id as rank): three times as fast, and equal on every code point
        self.ranked = tiktoken.Encoding("ranked", pat_str=WORD_PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        self.spaces = re.compile(r"\s{%d}" % SPACE_RUN)
        self.a_length, self.b_length = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.a_text = {end: np.array([f"{i}{end}" for i in range(size)], object) for end in ",|"}
        self.b_text = {end: np.array([f"{i}{end}" for i in range(len(self.b_bytes))], object) for end in ",;"}

    def _a_ids(self, text: str) -> list[int]:
        if len(text) >= SPACE_RUN and self.spaces.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text, or nothing where either tokenizer doesn't keep all its bytes."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            text = " " + text
            a, whole = self._a_ids(text), text.encode()
            if len(whole) == 1 or b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
                yield None
            else:
                yield np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=1)
def _pair(byte_bpe: str, pieces: bytes) -> Pair:
    return Pair(byte_bpe, pieces)


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each end of `short` the place of the first end of `long` at or behind it; both lists close with the same end."""
    places, at, last = [], 0, len(long) - 1
    for end in short:
        if long[at] < end:
            low, step = at, 1
            at += 1
            while at < last and long[at] < end:
                low = at
                step <<= 1
                at += step
            if step > 1:
                at = bisect_left(long, end, low + 1, min(at, last) + 1)
        places.append(at)
    return places


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all overlapping pairs, and per side the number of tokens up to each common end."""
    swap = len(b_ends) < len(a_ends)
    short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
    places = np.array(gallop(short.tolist(), long.tolist()), np.int64)
    hit = long[places] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = (places + hit)[:-1]
    size = places - first + 1
    ends = np.cumsum(size)
    one = np.repeat(np.arange(len(short)), size)
    other = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
    cuts, other_cuts = np.flatnonzero(hit) + 1, places[hit] + 1
    return (other, one, other_cuts, cuts) if swap else (one, other, cuts, other_cuts)


def groups_text(pair: Pair, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group, A before B."""
    a_size, b_size = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    a_words, b_words = pair.a_text[","][a], pair.b_text[","][b]
    a_words[a_cuts - 1] = pair.a_text["|"][a[a_cuts - 1]]
    b_words[b_cuts - 1] = pair.b_text[";"][b[b_cuts - 1]]
    words = np.empty(len(a) + len(b), object)
    words[np.arange(len(a)) + np.repeat(b_cuts - b_size, a_size)] = a_words
    words[np.arange(len(b)) + np.repeat(a_cuts, b_size)] = b_words
    return "".join(words.tolist())[:-1]


def aligned_row(pair: Pair, ids: tuple[np.ndarray, np.ndarray] | None) -> dict:
    """Counts, groups and the different links (A id * 2^32 + B id, and how often) of one text."""
    if ids is None:
        return EMPTY
    a, b = ids
    left, right, a_cuts, b_cuts = overlaps(np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b]))
    pairs, times = np.unique(a[left] << 32 | b[right], return_counts=True)
    return {
        "n_a": len(a), "n_b": len(b), "n_groups": len(a_cuts), "n_links": len(left), "groups": groups_text(pair, a, b, a_cuts, b_cuts),
        "pairs": pairs, "times": times.astype(np.int32),
    }


def align(df: DataFrame, byte_bpe: str, pieces: str, text: str = "text") -> DataFrame:
    """Replace `text` by `n_a, n_b, n_groups, n_links, groups, pairs, times`; the paths name the two vocabularies."""
    spark = df.sparkSession
    with open(byte_bpe, encoding="utf-8") as one, open(pieces, "rb") as two:
        sent = spark.sparkContext.broadcast((one.read(), two.read()))
    kept = [c for c in df.columns if c != text and c not in dict(ALIGNED)]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in ALIGNED]])
    types = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = [aligned_row(pair, ids) for ids in pair.encode([t or "" for t in part.column(text).to_pylist()])]
                columns = [pa.array([r[n] for r in rows], types[n]) for n, _ in ALIGNED]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *columns], schema.names)

    return df.mapInArrow(run, schema)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2^32, byte planes compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _as_bytes(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for r in rows:
            out.write_batch(r)
    return sink.getvalue().to_pybytes()


def _chunk(rows: list[pa.RecordBatch], pairs: list[np.ndarray], times: list[np.ndarray], sizes: list[np.ndarray]) -> dict:
    """One chunk: its different pairs with their documents, and its rows with places in that list."""
    size = np.concatenate(sizes)
    every, place, docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    step = np.diff(place, prepend=0)  # places rise inside a document: small steps
    first = (np.cumsum(size) - size)[size > 0]
    step[first] = place[first]
    links = [_pack(x) for x in (size, step, np.concatenate(times))]
    return {"chunk": uuid.uuid4().hex, "pairs": every, "docs": docs, "rows": _as_bytes(rows), "links": links}


def _chunks(batches: Iterator[pa.RecordBatch], kept: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk", pa.string()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("rows", pa.binary()), ("links", pa.list_(pa.binary()))])
    held: tuple[list, list, list, list] = ([], [], [], [])
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            pairs, times = part.column("pairs"), part.column("times")
            flat = pairs.flatten().to_numpy(zero_copy_only=False)
            for x, y in zip(held, (part.select(kept), flat, times.flatten().to_numpy(zero_copy_only=False), pairs.value_lengths().to_numpy(zero_copy_only=False)), strict=True):
                x.append(y)
            n += len(flat)
            if n >= limit:
                yield pa.RecordBatch.from_pylist([_chunk(*held)], schema)
                held, n = ([], [], [], []), 0
    if held[0]:
        yield pa.RecordBatch.from_pylist([_chunk(*held)], schema)


def _scored(row: dict) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk with the sums over their links; `figures` holds 2 * count + (is the A id's highest) per place."""
    figures = np.zeros(max((x["place"] for x in row["figures"] or []), default=-1) + 1, np.int64)
    for x in row["figures"] or []:
        figures[x["place"]] = x["figure"]
    size, step, times = (_unpack(x) for x in row["links"])
    begin = np.cumsum(size) - size
    total = np.cumsum(step)  # places start anew in each document
    base = np.where(size > 0, np.append(0, total)[np.minimum(begin, len(step))], 0)
    figure = figures[total - np.repeat(base, size)]
    best, counts = (np.append(0, np.cumsum(x)) for x in ((figure & 1) * times, (figure >> 1) * times))
    at = 0
    for rows in pa.ipc.open_stream(row["rows"]):
        here = slice(at, at + rows.num_rows)
        at += rows.num_rows
        sums = [pa.array(x[(begin + size)[here]] - x[begin[here]], pa.int64()) for x in (best, counts)]
        yield pa.RecordBatch.from_arrays([*rows.columns, *sums], [*rows.schema.names, *[n for n, _ in SCORED]])


def score_links(aligned: DataFrame, limit: int = CHUNK_LINKS) -> DataFrame:
    """Replace `pairs, times` by `n_best` (links whose document count is their A id's highest) and `count_sum`."""
    kept = [c for c in aligned.columns if c not in ("pairs", "times", *dict(SCORED))]
    chunks = stage(aligned.mapInArrow(lambda batches: _chunks(batches, kept, limit), "chunk string, pairs array<long>, docs array<long>, rows binary, links array<binary>"))
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = counts.select("pair", (F.col("n") * 2 + (F.col("n") == highest).cast("long")).alias("figure"))
    figures = listed.select("chunk", "place", "pair").join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "figure")).alias("figures"))
    schema = T.StructType([*[aligned.schema[c] for c in kept], *[T.StructField(n, t) for n, t in SCORED]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _scored(batch.slice(k, 1).to_pylist()[0])

    return chunks.select("chunk", "rows", "links").join(figures, "chunk", "left").drop("chunk").mapInArrow(finish, schema)
