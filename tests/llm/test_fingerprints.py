"""Fingerprints against a plain Python version."""

import hashlib
import re
import struct

from xxhash import xxh64

from gridwake.llm import fingerprints as fp
from gridwake.llm.queries import LLM_QUERIES


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _chain(values):
    seed = 42
    for v in values:
        seed = xxh64(v if isinstance(v, bytes) else struct.pack("<q", v), seed=seed).intdigest()
    return _signed(seed)


def brute(text):
    words = [_chain([w.encode()]) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return ""
    grams = {_chain(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    bins = {}
    for h in sorted(grams):
        bins.setdefault((h >> 57) + 64, h)
    out = []
    for j in range(128):
        donor = j if j in bins else min(bins, key=lambda b: _chain([j, b]))
        out.append("0123456789abcdef".upper()[bins[donor] & 15])
    return "".join(out)


def near(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 1 / 16) / (1 - 1 / 16))


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in LLM_QUERIES["op9_fingerprints"](spark, path).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(text) // 4
        edit = text[: len(text) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute(text), brute(edit))
        assert abs(r.near_edited - near(brute(text), brute(edit))) < 1e-12 and abs(r.near_next - near(brute(text), brute(after))) < 1e-12


def test_edges(spark):
    rows = [(None, "a b c d e f", "x"), (1, None, "y"), (2, "one", "y"), (2, "one", "y"), (9, "w " * 30_000, None), (5, " \t", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, packed string")
    got = fp.with_next(df).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].packed is None and by[1].next_text == ""  # a quarter of nothing
    assert by[2].next_packed is None and by[5].next_packed == by[9].packed
    assert by[9].next_packed == by[None].packed and by[None].next_packed == by[1].packed
    assert fp.with_next(df.limit(0)).count() == 0
    alone = fp.with_next(df.filter("doc_id = 9")).first()
    assert alone.next_packed == alone.packed and alone.next_text == ("w " * 30_000)[:15_000]
