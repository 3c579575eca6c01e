"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop per byte; the gadget of merge
`(a, b)` redirects every `a` arc to a copy of its target without the `b` arc and adds an `ab` arc
past both. All arcs with one label end in one state, so a state is named by the token that leads
to it, and the automaton accepts exactly one path per text: the BPE tokenization. The finished
automaton of a 50,000-token vocabulary has up to 50,000**2 arcs; `MergeAutomaton` therefore
compiles the transition table arc by arc, when an arc is first met, from the same gadgets. Both that
table and the cache of words have a fixed size.

Texts are split as the vocabulary's pre-tokenizer does, each distinct word is run once per worker,
and ids are packed as little-endian unsigned 32-bit integers. The vocabulary (bounded by its file)
is broadcast; texts never leave their partition.

Cases: a null text is the empty text; an empty text has no ids and decodes to ''; repeated rows
are encoded alike; other columns pass through, and an output column replaces one of its name.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The public byte-level pre-tokenizer pattern.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points that the regex module knows as letters or numbers (Unicode 17 on) and the
#: tokenizers' own pattern engine doesn't know yet; hexadecimal.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""

#: Words and arcs kept per worker, and the longest word kept; a full table is emptied, which changes no result.
CACHE_WORDS = 400_000
CACHE_ARCS = 500_000
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    """Tokens as labels and states, merges as gadgets, transitions compiled on demand."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        byte_of, model = byte_alphabet(), spec["model"]
        raw = lambda s: bytes(byte_of[c] for c in s)
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.label: list[bytes] = [b""] * size
        for text, i in ids.items():
            if text not in self.special:
                self.label[i] = raw(text)
        self.token = {b: i for i, b in enumerate(self.label) if b}
        self.label = [*self.label]
        for text, i in self.special.items():
            self.label[i] = text.encode()
        self.prefixes = {b[:k] for b in self.token for k in range(1, len(b) + 1)}
        self.born, self.parts, self.gadget = [0] * size, {}, {}
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = ids[a], ids[b], ids[a + b]
            self.gadget[a, b] = rank
            self.parts[ab] = a, b
            self.born[ab] = rank
        self.size, self.table = size, {}

    def arc(self, state: int, label: int, time: int) -> bool:
        """Does the state have the arc after the first `time` gadgets?"""
        rank = self.gadget.get((state, label))
        if rank is not None and rank <= time:
            return False
        at, new = self.born[state], self.born[label]
        if not at and not new:
            return True
        if new >= at:  # the label's gadget gave the arc to states that still had its first part
            return self.arc(state, self.parts[label][0], new)
        return self.arc(self.parts[state][1], label, at - 1)  # the state began as the end of its second part

    def step(self, state: int, label: int) -> bool:
        key = state * self.size + label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CACHE_ARCS:
                self.table.clear()
            known = self.table[key] = self.arc(state, label, len(self.gadget))
        return known

    def run(self, word: bytes) -> list[int]:
        """Labels of the one accepted path over the word's bytes."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # start and label of the arc that ends here
        for i in range(n):
            if i and back[i] is None:
                continue
            state = back[i][1] if i else -1
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in self.prefixes:
                    break
                label = self.token.get(piece)
                if label is not None and (not i or self.step(state, label)):
                    back[j] = i, label
        out, end = [], n
        while end:
            end, label = back[end]
            out.append(label)
        return out[::-1]


def _patterns() -> tuple:
    """For most texts; a test for later code points; for texts that have some."""
    later = "[" + "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split()) + "]"
    strict = WORD_PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{later}]")
    strict = regex.sub(r"(?<=\?)\\p\{(\w)\}\+", lambda m: rf"[\p{{{m[1]}}}--{later}]+", strict)
    return regex.compile(WORD_PATTERN), regex.compile(later), regex.compile(strict, regex.V1)


@lru_cache(maxsize=2)
def _compiled(vocabulary: str) -> tuple:
    auto = MergeAutomaton(vocabulary)
    special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(auto.special, key=len, reverse=True)) + ")") if auto.special else None
    return auto, _patterns(), special, {}


def _codec(vocabulary: str):
    auto, (words, later, strict), special, cache = _compiled(vocabulary)

    def pack(word: str) -> bytes:
        got = np.array(auto.run(word.encode()), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[word] = got
        return got

    def plain(text: str) -> list[bytes]:
        split = words if text.isascii() or not later.search(text) else strict
        return [cache.get(w) or pack(w) for w in split.findall(text)]

    def encode(text: str) -> bytes:
        if special is None or not special.search(text):
            return b"".join(plain(text))
        out: list[bytes] = []
        for piece in special.split(text):
            out += [np.array([auto.special[piece]], "<u4").tobytes()] if piece in auto.special else plain(piece)
        return b"".join(out)

    def decode(ids: bytes) -> str:
        label = auto.label
        return b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")

    return encode, decode


def _broadcast(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add `ids`: the packed ids of each text."""
    vocabulary = _broadcast(df, path)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, _ = _codec(vocabulary.value)
        for batch in batches:
            yield pd.Series([enc(t or "") for t in batch], dtype=object)

    return df.withColumn(ids, run(F.col(f"`{text}`")))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add `text`: the labels of the packed ids, one after the other."""
    vocabulary = _broadcast(df, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, dec = _codec(vocabulary.value)
        for batch in batches:
            yield pd.Series([dec(b or b"") for b in batch], dtype=object)

    return df.withColumn(text, run(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", release: bool = False) -> DataFrame:
    """`encode`, then `decode` of its ids, in one visit of each batch; with `release` a task frees the automaton when it ends."""
    vocabulary = _broadcast(df, path)

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc, dec = _codec(vocabulary.value)
        for batch in batches:
            packed = [enc(t or "") for t in batch]
            yield pd.DataFrame({"ids": packed, "decoded": [dec(p) for p in packed]}, dtype=object)
        if release:
            del enc, dec
            _compiled.cache_clear()
            gc.collect()

    both = run(F.col(f"`{text}`"))
    return df.withColumn("__codec", both).withColumns({ids: F.col("__codec.ids"), decoded: F.col("__codec.decoded")}).drop("__codec")


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of ids of each text; the ids themselves stay in the worker."""
    vocabulary = _broadcast(df, path)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, _ = _codec(vocabulary.value)
        for batch in batches:
            yield pd.Series([len(enc(t or "")) // 4 for t in batch], dtype="int64")

    return df.withColumn(out, run(F.col(f"`{text}`")))


def n_tokens(ids: str = "ids") -> Column:
    return (F.length(F.col(f"`{ids}`")) / 4).cast("long")


def digest(ids: list[int]) -> str:
    """Lowercase hex SHA-256 of packed ids, as the query reports it."""
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
