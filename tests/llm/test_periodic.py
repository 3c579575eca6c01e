"""Runs against a scan of every period."""

import random

import numpy as np

from gridwake.llm import periodic


def scan(words, least):
    """Runs by comparing words q apart for every q."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def test_against_scan():
    draw = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 5)):
            kinds, n = draw.choice([1, 2, 2, 3, 5]), draw.choice([0, 1, 2, 13, 30, 90])
            words = [bytes([97 + draw.randrange(kinds)]) for _ in range(n)]
            if n and draw.random() < 0.5:
                a = draw.randrange(n)
                p = 1 + (n - a) // draw.randint(1, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least = draw.choice([2, 4, 12])
        assert periodic.find_runs(*periodic._codes(texts), least) == [scan(w, least) for w in texts]


def test_interval_bounds():
    lcp = [0, 2, 2, 1, 3, 0, 4]
    left, right = periodic.interval_bounds(np.array(lcp))
    assert [(left[k], right[k]) for k in (1, 2, 3, 4, 6)] == [(0, 3), (0, 3), (0, 5), (3, 5), (5, 7)]


def test_frames(spark):
    long = " ".join(f"w{k}" for k in range(30)) + " again" * 50_000
    rows = [
        (1, "a b a b a b a b a b a b c", "x"), (2, None, "x"), (3, "", None), (3, " \t\n ", None), (None, "q " * 12, "y"),
        (1, "a b a b a b a b a b a b c", "x"), (4, long, "z"), (5, "a b " * 13, ""), (6, "a b c d e f", "n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = [(r.doc_id, r.found) for r in periodic.detect(df).collect()]
    runs = {i: [tuple(x) for x in f.runs] for i, f in got}
    texts = {i: f.collapsed for i, f in got}
    assert len(got) == len(rows)
    assert runs[1] == [(0, 12, 2)] and texts[1] == "a b c"
    assert runs[2] == runs[3] == [] and texts[2] == texts[3] == ""
    assert runs[None] == [(0, 12, 1)] and texts[None] == "q"
    assert runs[4] == [(30, 50_000, 1)] and texts[4] == long[: long.index(" again") + 6]
    assert runs[5] == [(0, 13, 1)]  # a no-break space is part of a word
    assert texts[6] == "a b c d e f"
    assert periodic.detect(df.limit(0)).count() == 0


def test_period_is_written(spark):
    """Ids whose crc ends in 0 get the stated rewriting, others stay as they are."""
    import zlib

    text = " ".join(f"w{k}" for k in range(97))
    df = spark.createDataFrame([(k, text) for k in range(200)] + [(None, text)], "doc_id long, text string")
    for r in df.select("doc_id", periodic.with_period(df.text, df.doc_id).alias("t")).collect():
        words, h = text.split(), None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is not None and h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.t == " ".join(words)
