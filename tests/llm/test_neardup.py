"""Near-duplicate classes against all pairs of a small table."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridwake.llm import neardup
from gridwake.llm.queries import LLM_QUERIES
from gridwake.llm.shingling import shingle_blocks

PATH = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_shingles_follow_words():
    draw = random.Random(1)
    texts = [None, "", " ", "a", "a b", *[" ".join(draw.choices(["é", "b", "cc", "日"], k=draw.randint(1, 40))) + draw.choice(["", "\n", " x\t"]) for _ in range(300)]]
    got = [g for block in shingle_blocks(pa.array(texts)) for g in block]
    seen = {}
    for text, hashes in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert len(want) == len(hashes)
        for a, b in zip(want, hashes.tolist()):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_samples_agree_as_often_as_weighted_jaccard():
    draw = np.random.default_rng(4)
    sampler = neardup.Sampler(1500)
    pool = draw.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:300]), np.sort(pool[60:])
    tf = {int(g): int(t) for g, t in zip(pool, draw.integers(1, 4, 400))}
    st = {int(g): int(s) for g, s in zip(pool, draw.integers(0, 16, 400))}
    of = lambda x: (x, np.array([tf[int(g)] for g in x]), np.array([st[int(g)] for g in x], np.uint8))
    agree = (sampler.samples(*of(a)) == sampler.samples(*of(b))).mean()
    w = {g: tf[g] * (1 + neardup.SPAN * st[g] / 15) for g in tf}
    sa, sb = set(a.tolist()), set(b.tolist())
    truth = sum(w[g] for g in sa & sb) / sum(w[g] for g in sa | sb)
    assert abs(agree - truth) < 0.05


def test_screen_keeps_all_pairs_within_reach_and_few_others(spark):
    draw = np.random.default_rng(6)
    steps = draw.integers(0, neardup.STEPS + 1, 1 << neardup.DF_BITS).astype(np.uint8)
    weights = 1 + neardup.SPAN * steps / neardup.STEPS
    assert neardup.UNIT == neardup.STEPS / neardup.SPAN
    rows = []
    for _ in range(3000):
        base = draw.integers(0, 1 << 32, draw.integers(1, 260)).astype("<u4")
        sides = []
        for _ in range(2):
            side = base.copy()
            changed = draw.integers(0, 1 + len(base) // 4)
            side[draw.integers(0, len(base), changed)] = draw.integers(0, 1 << 32, changed)
            sides.append(np.sort(np.concatenate([side, side[: draw.integers(0, 1 + len(base) // 10)]])).astype("<u4"))
        rows.append((neardup.weighted_jaccard(*sides, weights), *[neardup.bit_sketch(x, steps) for x in sides]))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    got = df.select("j", neardup.may_reach(0.8)(F.col("a"), F.col("b")).alias("on")).collect()
    assert all(r.on for r in got if r.j >= 0.8) and sum(r.j >= 0.8 for r in got) > 200
    below = [r.on for r in got if r.j < 0.74]
    assert len(below) > 200 and sum(below) < len(below) / 10


def brute_classes(table):
    """Least id of the class of every id, from all pairs."""
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    docs = {i: grams(t) for i, t in texts.items()}
    weights = 1 + neardup.SPAN * neardup.steps_of(neardup.cell_counts(table), len(docs)) / 15
    multis = {}
    for i, t in texts.items():
        u, f = np.unique(next(iter(shingle_blocks(pa.array([t]))))[0], return_counts=True)
        multis[i] = np.repeat((u >> np.uint64(32)).astype("<u4"), f)
    ids = sorted(docs)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if docs[a] == docs[b] or (docs[a] & docs[b] and neardup.weighted_jaccard(multis[a], multis[b], weights) >= 0.8):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def test_query_against_all_pairs(spark):
    want = brute_classes(spark.read.parquet(f"{PATH}/documents.parquet"))
    got = {r.doc_id: r for r in LLM_QUERIES["op5_near_duplicates"](spark, PATH).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert sorted(i for i, r in got.items() if r.kept) == sorted(set(want.values()))


def test_large_near_group_and_edges(spark):
    draw = random.Random(2)
    base = [f"w{draw.randint(0, 500)}" for _ in range(120)]
    rows = [(k, " ".join(base[:k % 100] + ["edit"] + base[k % 100 + 1 :])) for k in range(80)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (203, "one two"), (None, "x " * 40_000), (205, "x " * 40_000), (206, " ".join(f"z{k}" for k in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("id", F.lit(1))
    got = neardup.classes(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.class_id, []).append(r)
    assert {r.id for r in by[0]} == set(range(80))
    assert {r.id for r in by[200]} == {200, 201, 202} and len(by[203]) == 2 and len(by[206]) == 1
    assert {r.id for r in by[205]} == {None, 205}
    assert all(sum(r.kept for r in v) == 1 for v in by.values())
    left = neardup.drop_copies(df)
    assert left.columns == df.columns and left.count() == len(by)
    assert neardup.classes(df.limit(0)).count() == 0


def test_texts_that_share_a_bucket_are_picked_without_a_shuffle_of_all(spark, monkeypatch):
    rows = [(k, f"alpha beta gamma delta number {k} and some words more {k * k} end") for k in range(40)] + [(100 + k, "the same text of a few words stands here") for k in range(3)]
    plans, stage = [], neardup.stage

    def staged(df):
        if "sketch" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(neardup, "stage", staged)
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.class_id for r in got.filter("id >= 100").collect()} == {100}
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Join" not in plans[0]
