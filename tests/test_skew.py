"""Chunked operators against brute force, with one run that holds most rows and tiny chunks."""

import numpy as np
from pyspark.sql import functions as F

from gridwake.operators import calibration as C
from gridwake.operators import events as E
from gridwake.operators import grid as G
from gridwake.plans import ordered as O
from gridwake.plans.quantiles import quantiles


def hot_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    runs = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n))
    return rng, runs


def test_quantiles_equal_numpy(spark):
    rng, runs = hot_rows(0)
    vals = np.round(rng.normal(size=len(runs)), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(runs, vals)], "g long, v double")
    got = quantiles(df, ["g"], "v", {"hi": (0.9, "higher"), "med": (0.5, "linear"), "q": (0.37, "linear")}, cuts=[-1.0, -0.2, 0.0, 0.3, 1.1]).collect()
    for r in got:
        v = vals[runs == r["g"]]
        np.testing.assert_allclose([r["hi"], r["med"], r["q"]], [np.quantile(v, 0.9, method="higher"), np.median(v), np.quantile(v, 0.37)], atol=1e-12)


def test_gate_and_rolling_with_small_blocks(spark):
    rng, runs = hot_rows(1)
    score = rng.random(len(runs))
    rows, want = [], {}
    for g in set(runs.tolist()):
        streak = 0
        for w, s in enumerate(score[runs == g]):
            rows.append((int(g), w, float(s)))
            streak = streak + 1 if s > 0.4 else 0
            want[int(g), w] = streak >= 3
    df = spark.createDataFrame(rows, "run long, w long, score double").withColumn("x", (F.col("score") > 0.4).cast("int"))
    got = O.rolling(df, ["run"], "w", 3, {"hits": F.sum("x")}, size=4)
    assert {(r["run"], r["w"]): r["hits"] == 3 for r in got.collect()} == want
    whole = C.sustained_gate(df, F.lit(0.4), 3)
    assert {(r["run"], r["w"]): r["gate"] for r in whole.collect()} == want
    # causal: dropping the tail never changes earlier gates
    head = C.sustained_gate(df.filter("w < 20"), F.lit(0.4), 3)
    assert all(want[r["run"], r["w"]] == r["gate"] for r in head.collect())


def test_dense_index_and_prefix_sums(spark):
    rng, runs = hot_rows(2)
    t = rng.permutation(len(runs)) * 3
    df = spark.createDataFrame([(int(g), int(x), float(x % 7)) for g, x in zip(runs, t)], "run long, t long, v double").withColumn("c", F.floor(F.col("t") / 50))
    got = O.dense_index(df, ["run"], ["c"], [F.col("t")])
    for r in got.collect():
        mine = np.sort(t[runs == r["run"]])
        assert r["idx"] == int(np.searchsorted(mine, r["t"])) and r["idx_total"] == len(mine)


def test_resample_equals_interp(spark):
    rng, runs = hot_rows(3, 200)
    rows, grid = [], []
    series = {}
    for g in set(runs.tolist()):
        n = int((runs == g).sum())
        ts = np.sort(rng.choice(5000, n, replace=False))
        v = rng.normal(size=n)
        series[int(g)] = (ts, v)
        rows += [(int(g), "a", int(a), float(b)) for a, b in zip(ts, v)]
        grid += [(int(g), k, k * 130 - 100, 45) for k in range(45)]
    tel = spark.createDataFrame(rows, "run long, channel string, ts_us long, value double")
    gdf = spark.createDataFrame(grid, "run long, k long, ts_us long, rows long")
    for r in G.resample_linear(tel, gdf, ["a"], 400).collect():
        ts, v = series[r["run"]]
        if len(ts) < 2:
            assert r["value"] is None
        else:
            assert abs(r["value"] - np.interp(r["ts_us"], ts, v)) < 1e-9


def walk(lab, hit):
    """Greedy matching by the rule: each predicted event takes the first free true event it touches."""

    def segs(x):
        out, start = [], None
        for i, f in enumerate([*x, 0]):
            if f and start is None:
                start = i
            if not f and start is not None:
                out.append((start, i - 1))
                start = None
        return out

    true, pred, used = segs(lab), segs(hit), set()
    for p in pred:
        for i, t in enumerate(true):
            if i not in used and p[0] <= t[1] and t[0] <= p[1]:
                used.add(i)
                break
    return len(true), len(pred), len(used)


def test_event_matching_equals_greedy_rule(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(300):
        n = int(rng.integers(1, 60)) if g else 900
        p, q = rng.random(2)
        lab, hit = (rng.random(n) < p).astype(int), (rng.random(n) < q).astype(int)
        rows += [(g, i, int(a), float(b)) for i, (a, b) in enumerate(zip(lab, hit))]
        want[g] = walk(lab, hit)
    df = spark.createDataFrame(rows, "group long, start long, label long, score double")
    got = {r["group"]: (r["true_events"], r["pred_events"], r["matched"]) for r in E.event_f1(df, 0.5, chunk_width=16).collect()}
    assert got == want
    lab, hit = [r[2] for r in rows], [r[3] for r in rows]
    pooled = E.event_f1(df, 0.5, by=(), chunk_width=16).first()
    assert (pooled["true_events"], pooled["pred_events"], pooled["matched"]) == walk(lab, hit)


def test_dense_week_is_cut_into_equal_parts(spark, monkeypatch):
    monkeypatch.setattr(O, "DENSE", 50)
    rng = np.random.default_rng(6)
    # 4,000 of 4,400 samples of one series lie in a twentieth of one bucket, with ties among them
    ts = np.concatenate([rng.choice(np.arange(1000, 6000), 4000, replace=False), rng.integers(0, 1_000_000, 400)])
    ts = np.unique(ts)
    v = rng.normal(size=len(ts))
    tel = spark.createDataFrame([("hot", "a", int(a), float(b)) for a, b in zip(ts, v)] + [("cold", "a", 5, 1.0), ("cold", "a", 900, 2.0)], "run string, channel string, ts_us long, value double")
    chunked = O.with_time_chunk(tel, ["run", "channel"], "ts_us", 100_000)
    sizes = [r["count"] for r in chunked.groupBy("run", "channel", "_chunk").count().collect()]
    assert sum(sizes) == tel.count() and max(sizes) <= 150
    # parts follow time: no part of a series begins before the part before it has ended
    spans = sorted((r["run"], r["lo"], r["hi"], r["_chunk"]) for r in chunked.groupBy("run", "_chunk").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).collect())
    assert all(a[0] != b[0] or (a[2] < b[1] and a[3] < b[3]) for a, b in zip(spans, spans[1:]))
    points = np.arange(0, 1_000_000, 777)
    grid = spark.createDataFrame([("hot", k, int(t), len(points)) for k, t in enumerate(points)], "run string, k long, ts_us long, rows long")
    for r in G.resample_linear(tel, grid, ["a"], 100_000).collect():
        assert abs(r["value"] - np.interp(r["ts_us"], ts, v)) < 1e-9
    gaps = {r["ts_us"]: r["gap_us"] for r in G.sample_gaps(tel, 100_000).filter("run = 'hot'").collect()}
    assert gaps == {int(t): None if k == 0 else int(t - ts[k - 1]) for k, t in enumerate(ts)}


def test_pooled_scan_over_many_runs(spark):
    runs = 10_000
    rng = np.random.default_rng(8)
    lab, hit = (rng.random(2 * runs) < 0.6).astype(int), (rng.random(2 * runs) < 0.6).astype(int)
    rows = [(k // 2, k % 2, int(a), float(b)) for k, (a, b) in enumerate(zip(lab, hit))]
    df = spark.createDataFrame(rows, "group long, start long, label long, score double")
    got = E.event_f1(df, 0.5, by=()).first()
    assert (got["true_events"], got["pred_events"], got["matched"]) == walk(lab.tolist(), hit.tolist())
    # a task of the scan sees the chunks of one range, or one row per range
    chunks = spark.createDataFrame([(k, 0) for k in range(runs)], "group long, b long").select(F.struct("group", "b").alias("_chunk"))
    ranges = O.with_ranges(chunks, ["_chunk"]).groupBy("_range").agg(F.count("*").alias("n"), F.min("_chunk.group").alias("lo"), F.max("_chunk.group").alias("hi"))
    got = sorted((r["_range"], r["n"], r["lo"], r["hi"]) for r in ranges.collect())
    assert O.RANGES // 2 <= len(got) <= O.RANGES + 1 and max(n for _, n, _, _ in got) <= 4 * runs / O.RANGES
    assert all(a[3] < b[2] for a, b in zip(got, got[1:]))


def test_ranged_scans_equal_plain_ones(spark):
    rng, runs = hot_rows(9)
    rows = [(int(g), k, float(x)) for k, (g, x) in enumerate(zip(runs, rng.random(len(runs))))]
    df = spark.createDataFrame(rows, "run long, t long, v double").withColumn("c", F.floor(F.col("t") / 5))
    for down in (False, True):
        order = [F.col("t").desc() if down else F.col("t").asc()]
        plain, cut = [O.prefix_sums(df, ["run"], ["c"], order, {"s": (F.col("v") > 0.5).cast("long")}, down, ranged=ranged) for ranged in (False, True)]
        assert sorted(plain.collect()) == sorted(cut.select(plain.columns).collect())
    point = {"t": F.col("t"), "v": F.col("v")}
    plain, cut = [O.nearest_points(df, ["run"], "c", ["t"], point, F.col("v") > 0.7, ranged=ranged) for ranged in (False, True)]
    key = lambda r: (r["run"], r["t"])
    assert sorted(plain.collect(), key=key) == sorted(cut.select(plain.columns).collect(), key=key)
