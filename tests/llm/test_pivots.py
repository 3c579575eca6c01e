"""Classes from pivots against all pairs of each bucket."""

import random

from pyspark.sql import functions as F

from gridwake.llm import pivots
from gridwake.llm.pivots import LARGE, bucket_links, components


def brute(points, buckets, limit):
    top = {i: i for i in points}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for ids in buckets:
        for a in ids:
            for b in ids:
                if a < b and abs(points[a] - points[b]) <= limit:
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: find(i) for i in points}


def found(spark, points, buckets, limit):
    members = spark.createDataFrame([(k, i) for k, ids in enumerate(buckets) for i in ids], "bucket long, id long")
    payload = spark.createDataFrame(list(points.items()), "id long, data double")
    links = bucket_links(members, payload, lambda x, y: F.abs(x - y), limit, by_class=True)
    return {i: i for i in points} | {r["id"]: r["class"] for r in components(links).collect()}


def test_members_of_two_pivots_are_joined(spark):
    # 0 is the first pivot and reaches 2, 1 is the second and reaches 3; only 2-3 joins them
    points = {0: 0.0, 1: 2.7, 2: 0.9, 3: 1.8} | {10 + k: 100.0 + 10 * k for k in range(LARGE + 4)}
    want = brute(points, [list(points)], 1.0)
    assert want[1] == want[2] == want[3] == 0
    assert found(spark, points, [list(points)], 1.0) == want


def test_random_chains_against_all_pairs(spark):
    draw = random.Random(3)
    points = {i: draw.uniform(0, 90) for i in range(130)}
    buckets = [draw.sample(sorted(points), n) for n in (90, 60, 40, 12, 2)]
    assert found(spark, points, buckets, 1.0) == brute(points, buckets, 1.0)


def test_a_pair_is_compared_once_in_the_end(spark, monkeypatch):
    # every point stands four times in each of three buckets; no pivot of a round reaches another point
    points = {i: 100.0 * i for i in range(20)} | {20 + i: 5000.0 + 3 * i for i in range(40)} | {60 + i: 5001.0 + 3 * i for i in range(40)}
    members = spark.createDataFrame([(k, i) for k in range(3) for i in points for _ in range(4)], "bucket long, id long")
    payload = spark.createDataFrame(list(points.items()), "id long, data double")
    met, unruled = [], pivots._unruled
    monkeypatch.setattr(pivots, "_unruled", lambda *a: met.append(unruled(*a)) or met[-1])
    for by_class in (False, True):
        links = bucket_links(members, payload, lambda x, y: F.abs(x - y), 1.0, by_class=by_class)
        assert {(r.a, r.b) for r in links.collect()} == {(20 + i, 60 + i) for i in range(40)}
        pairs = [tuple(r) for r in met.pop().collect()]
        assert pairs and len(pairs) == len(set(pairs))


def test_members_of_shared_buckets_are_found_in_one_pass(spark):
    draw = random.Random(5)
    rows = [(b, draw.randrange(6)) for b in range(40) for _ in range(draw.choice((1, 1, 1, 2, 3, 30)))]
    want = {(b, i) for b, i in rows if len({j for c, j in rows if c == b}) > 1}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("1", "2", "5", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = pivots.shared_members(spark.createDataFrame(rows, "bucket long, id long"))
            assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_members_are_read_and_dealt_once(spark, monkeypatch):
    members = spark.range(200).selectExpr("id DIV 3 AS bucket", "id")
    payload = spark.range(200).selectExpr("id", "CAST(id AS DOUBLE) AS data")
    plans, stage = [], pivots.stage
    monkeypatch.setattr(pivots, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df))
    bucket_links(members, payload, lambda x, y: F.abs(x - y), 1.0).count()
    # all columns of all members: one shuffle, from one scan
    assert plans[0].count("Range (") == 1
