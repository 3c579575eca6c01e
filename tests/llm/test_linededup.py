"""Line deduplication against all pairs of lines."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridwake.llm import linededup
from gridwake.llm.queries import LLM_QUERIES
from gridwake.llm.shingling import row_blocks


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(diag + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_distance():
    draw = random.Random(7)
    xs, ys = [], []
    for _ in range(4000):
        a = [draw.randint(0, draw.choice([1, 3, 50])) for _ in range(draw.randint(10, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 7)):
            at = draw.randrange(len(b))
            b[at : at + draw.randint(0, 1)] = [draw.randint(0, 50)] * draw.randint(0, 1)
            b = b or [1]
        if len(b) >= 6:
            xs.append(np.array(a, "<u4"))
            ys.append(np.array(b, "<u4"))
    got = linededup.banded_distances(xs, ys)
    want = [min(5, edit(x.tolist(), y.tolist())) for x, y in zip(xs, ys)]
    assert got.tolist() == want


def brute(docs):
    """(id, line number) of the lines that go."""
    lines, hashes = [], {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                lines.append((i, k, words))
                if words not in hashes:
                    data, at = next(row_blocks(pa.array([line])))
                    hashes[words] = int(linededup._lines(data, at)[-1].view(np.int64)[0])
    near = set()
    long_ = sorted((w for w in hashes if len(w) >= linededup.SHORT_WORDS), key=len)
    for k, a in enumerate(long_):
        most = 2 if len(a) >= linededup.NEAR_WORDS else 1
        for b in long_[k + 1 :]:
            if len(b) - len(a) > most:
                break
            if len(set(a) & set(b)) >= len(set(a)) - 2 * most and edit(a, b) <= most:
                near.add(a if hashes[a] > hashes[b] else b)
    first, gone = {}, set()
    for i, k, w in sorted(lines, key=lambda x: x[:2]):
        if w in near or first.setdefault(w, (i, k)) != (i, k):
            gone.add((i, k))
    return gone


def result(docs, gone):
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    gone = brute(docs)
    got = {r.doc_id: r for r in LLM_QUERIES["op10_line_dedup"](spark, path).collect()}
    assert gone and {i: r.text for i, r in got.items()} == result(docs, gone)
    assert sum(r.n_dropped for r in got.values()) == len(gone)


def test_near_lines_in_large_groups(spark):
    draw = random.Random(11)
    base = [f"b{draw.randint(0, 99)}" for _ in range(25)]
    docs = []
    for k in range(150):
        line = list(base)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(line))
            line[at : at + draw.randint(0, 1)] = [f"n{draw.randint(0, 999)}"] * draw.randint(0, 2)
        docs.append((k, " ".join(line) + f"\nshort one\nkept {k} as only its number differs here\nin {k} and {k % 7} two words differ"))
    got = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == result(docs, brute(docs))
    assert sum("short one" in t for t in got.values()) == 1 and sum("kept" in t for t in got.values()) < 150


def test_lines_around_the_border_of_thresholds(spark):
    draw = random.Random(13)
    docs = []
    for k in range(400):
        line = [f"g{k % 8}w{n}" for n in range(draw.choice([3, 4, 5, 8, 9, 10, 11, 12]))]
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            at = draw.randrange(len(line))
            line[at : at + draw.randint(0, 1)] = [f"n{draw.randint(0, 30)}"] * draw.randint(0, 1)
            line = line or ["x"]
        docs.append((k, " ".join(line)))
    got = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = result(docs, brute(docs))
    assert got == want and 50 < sum(t == "" for t in want.values()) < 390


def test_edges(spark):
    same = "one two three four five"
    rows = [(1, None, 1), (2, "", 1), (3, same, 1), (3, same, 1), (4, f"{same}\n\n{same}\nab", 2), (None, f" {same}", 3), (6, "\n".join(f"q{k} r{k} s{k} t{k}" for k in range(5000)), 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int").withColumn("id", F.lit("x"))
    out = linededup.drop_lines(df, count="gone")
    assert out.columns == [*df.columns, "gone"]
    got = sorted(((r.doc_id or 0, r.text, r.gone) for r in out.collect()), key=str)
    assert got == sorted([(1, None, 0), (2, "", 0), (3, "", 1), (3, "", 1), (4, "\nab", 2), (0, f" {same}", 0), (6, rows[-1][1], 0)], key=str)
    assert linededup.drop_lines(df.limit(0)).count() == 0
