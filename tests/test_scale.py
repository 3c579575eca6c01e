"""Faults that show on larger tables, on small ones."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from gridwake.models import var1 as Va
from gridwake.operators import calibration as C
from gridwake.operators import events as E
from gridwake.operators import grid as G
from gridwake.operators import pairing as P
from gridwake.operators import windows as Wn
from gridwake.plans import ordered as O
from gridwake.plans.panes import WindowSpec, window_starts
from gridwake.queries import ORACLES, QUERIES

SPEC = WindowSpec(window=4, stride=2, horizon=1)


def planned(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def labelled(spark):
    bounds = spark.range(3).select(F.col("id").alias("run"), F.lit(0).cast("long").alias("start_us"), F.lit(390).cast("long").alias("stop_us"))
    hits = spark.createDataFrame([(1, 25, 60, 0, 2)], "run long, start_us long, end_us long, ordinal long, class_id long")
    return bounds, G.label_points(G.make_grid(bounds, 10), hits, bounds, 10)


def test_made_rows_are_not_broadcast(spark):
    """Rows made from few bounds look as few to the planner, which then sent all of them through the driver."""
    bounds, points = labelled(spark)
    assert "BroadcastHashJoin [run" not in planned(points).split("SortMergeJoin [run", 1)[0]
    runs = bounds.withColumn("rows", F.lit(40).cast("long"))
    windows = Wn.window_class(Wn.window_label(window_starts(runs, SPEC), points, SPEC), points, SPEC)
    assert "SortMergeJoin [run" in planned(windows)
    assert {(r.run, r.label) for r in windows.select("run", "label").collect()} == {(0, 0), (1, 0), (1, 1), (2, 0)}


def test_fit_points_are_not_broadcast(spark):
    windows = spark.range(2).select(F.col("id").alias("run"), F.lit(0).cast("long").alias("start_k"))
    steps = spark.range(8).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).alias("k"))
    joined = Va.fit_points(windows, SPEC).join(steps, ["run", "k"])
    assert "BroadcastHashJoin" not in planned(joined) and joined.count() == 6


def sparse_events(path):
    """Users with few events: channels that share no time, one sample a channel, no or one calibration window."""
    days = {
        1: [(0, "click"), (5, "click"), (10, "view"), (14.5, "view"), (14.6, "view")],
        2: [(0, "click"), (3, "view"), (20, "click"), (21, "click"), (22, "view")],
        3: [(0, "click"), (0.01, "view"), (13.5, "click"), (14, "view")],
        4: [(k / 4, ("click", "view")[k % 2]) for k in range(80)],
        5: [(0, "error")],
    }
    rows = [(u, d, e) for u, pairs in days.items() for d, e in pairs]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", [
        (k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=k), u, e, 10.0 + 7 * k % 50, f'{{"k": {k}}}') for k, (u, d, e) in enumerate(rows)
    ])
    con.execute(f"COPY e TO '{path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["d3_span_grid", "h21_self_calibrate"])
def test_users_with_few_events_equal_sql(spark, tmp_path, name):
    got = compare(spark, sparse_events(tmp_path), name, QUERIES, ORACLES, str(tmp_path))
    assert got["ok"] and got["rows"], got["why"]


def test_pooled_chunks_follow_rows(spark, monkeypatch):
    """Positions far apart made a chunk of nearly every row, and each was held against all boundaries."""
    rng = np.random.default_rng(3)
    lab, hit = (rng.random(400) < 0.6).astype(int), (rng.random(400) < 0.6).astype(int)
    rows = [(k // 4, (k % 4) << 20, int(a), float(b)) for k, (a, b) in enumerate(zip(lab, hit))]
    df = spark.createDataFrame(rows, "group long, start long, label long, score double")
    whole = E.event_f1(df, 0.5, by=()).collect()
    assert E._flagged(df, F.lit(0.5), [], 1 << 16).select("_chunk").distinct().count() == 1
    monkeypatch.setattr(O, "ROWS", 7)
    assert E._flagged(df, F.lit(0.5), [], 1 << 16).select("_chunk").distinct().count() > 30
    assert E.event_f1(df, 0.5, by=()).collect() == whole


def test_gaps_make_the_same_grid(spark, monkeypatch):
    """Only samples are scanned; empty series, single samples, long gaps and outer samples equal the made grid."""
    monkeypatch.setattr(G, "GRID_BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(0, "a", int(x), float(v)) for x, v in zip(np.sort(rng.choice(4000, 60, replace=False)) - 200, rng.normal(size=60))]
    rows += [(0, "b", 1000, 1.5), (1, "a", 0, 2.0), (1, "a", 3000, -1.0), (1, "c", 10, 9.0), (3, "a", 5, 1.0)]
    tel = spark.createDataFrame(rows, "run long, channel string, ts_us long, value double")
    bounds = spark.createDataFrame([(0, 0, 3500), (1, 100, 2900), (2, 7, 7)], "run long, start_us long, stop_us long")
    made = G.make_grid(bounds, 50)
    for how in ({}, {"single": "const"}, {"zero_empty": True}):
        want, got = [G.resample_linear(tel, g, ["a", "b"], 700, **how) for g in (made, G.Uniform(bounds, 50))]
        assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
    want, got = [G.resample_supported(tel, g, ["a", "b"], 700, 60.0) for g in (made, G.Uniform(bounds, 50))]
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_grid_reference_equals_as_of_join(spark, monkeypatch):
    """A reference on a grid is met by position; edges of blocks and of the reference equal the as-of join."""
    monkeypatch.setattr(P, "REFERENCE_BLOCK", 4)
    rng = np.random.default_rng(2)
    spans = [(0, 35, 235, 10_000, 10_000), (1, 0, 100, 90, 10_000), (2, 500, 500, 10_000, 10_000), (3, None, None, 10_000, None)]
    target = [(p, w, 10 * w, float(v)) for p in range(4) for w, v in enumerate(rng.normal(size=60))]
    reference = [(p, w, a + 10 * w, float(rng.normal())) for p, a, b, _, _ in spans[:3] for w in range((b - a) // 10 + 1)]
    t = spark.createDataFrame(target, "run long, w long, ts_us long, value double")
    ref = spark.createDataFrame(reference, "run long, w long, ts_us long, value double")
    sup = spark.createDataFrame(spans, "run long, first_us long, last_us long, target_end long, reference_end long")
    want = P.interp_join(t, ref.drop("w"), ["run"], 70, sup.drop("first_us", "last_us"), ["run"])
    got = P.interp_grid(t, ref, ["run"], 10, sup, ["run"])
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
    assert {r.run for r in got.collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="grids of one step"):
        P.interp_grid(t.withColumn("ts_us", F.floor(F.col("ts_us") / 2)), ref, ["run"], 10, sup, ["run"]).collect()


def test_pairs_from_samples_equal_made_grids(spark, monkeypatch):
    """Grids of pairs were written, shuffled and sorted whole; edges of blocks, gaps, short series and offsets equal them."""
    monkeypatch.setattr(P, "PAIR_BLOCK", 4)
    rng = np.random.default_rng(4)
    starts = {0: (0, 35), 1: (80, 0), 2: (500, 0), 3: (0, 20), 4: (5, 5)}
    rows = []
    for pair, (a, b) in starts.items():
        for side, start in enumerate((a, b)):
            for feature, n in (("x", 40), ("y", 1 + pair % 2), ("z", 6)):
                at = np.unique(np.append(rng.choice(300, n, replace=False) // (1 + pair % 3) * (1 + pair % 3), 0 if feature == "x" else 7)) + start
                rows += [(pair, side, feature, int(ts), float(v)) for ts, v in zip(at, rng.normal(size=len(at)))]
    rows += [(0, 0, "x", 2000, 1.0), (0, 1, "x", 1900, 4.0), (1, 1, "z", 700, 2.0), (4, 0, "x", 905, 3.0), (4, 1, "x", 905, 3.0)]
    samples = spark.createDataFrame(rows, "run long, side int, feature string, ts_us long, value double").groupBy("run", "side", "feature", "ts_us").agg(F.min("value").alias("value"))
    items, step = ["x", "y", "z", "none"], 10
    b = samples.groupBy("run", "side").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("stop_us"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, c))
    size = G.grid_rows(F.col("start_us"), F.col("stop_us"), step)
    per = b.groupBy("run").agg(
        pick(0, F.col("start_us")).alias("target_start"), pick(0, size).alias("target_rows"), pick(1, F.col("start_us")).alias("reference_start"),
        pick(1, size).alias("reference_rows"), pick(0, F.col("stop_us")).alias("target_end"), pick(1, F.col("stop_us") - 15).alias("reference_end"),
    )
    spans = P.pair_spans(per, step)
    sides = []
    for side in (0, 1):
        tel = samples.filter(F.col("side") == side).withColumnRenamed("feature", "channel")
        made = G.resample_linear(tel, G.Uniform(b.filter(F.col("side") == side), step), items, 100, zero_empty=True)
        sides.append(made.select("run", F.col("k").alias("w"), "ts_us", F.col("channel").alias("feature"), "value"))
    last = F.col("reference_start") + (F.col("reference_rows") - 1) * step
    sup = per.select("run", F.col("reference_start").alias("first_us"), last.alias("last_us"), "target_end", "reference_end")
    want = P.interp_grid(*sides, ["run", "feature"], step, sup, ["run"]).select("run", "w", "feature", "value", "matched").collect()
    got = P.interp_samples(samples, spans.filter("windows > 0"), items, step).collect()
    digits = lambda found: sorted((r.run, r.w, r.feature, round(r.value, 9), round(r.matched, 9)) for r in found)
    assert digits(got) == digits(want) and len(got) > 400 and len({r.run for r in got}) == 4
    counts = {r.run: r.windows for r in spans.collect()}
    assert counts == {p: len({r.w for r in want if r.run == p}) for p in starts} and 0 in counts.values()


def test_few_keys_deal_no_rows(spark):
    """Rows were dealt by the ten features, or met a copy of themselves, to learn a value per feature."""
    rows = spark.range(400).select(F.lit(0).alias("run"), (F.col("id") / 4).cast("long").alias("w"), (F.col("id") % 4).alias("feature"), F.lit(3.0).alias("residual"))
    noise = rows.groupBy("feature").agg(F.avg("residual").alias("noise"))
    assert "BroadcastHashJoin [feature" in C.scaled_residual(rows, noise)._jdf.queryExecution().executedPlan().toString()
    gate = rows.select("run", "w", (F.col("w") % 2 == 0).alias("gate")).distinct()
    out = C.gated_evidence(rows.withColumnRenamed("residual", "value"), noise.select("feature", (F.col("noise") / 2).alias("value")), gate, ["run"], "feature")
    assert {(r.feature, r.evidence) for r in out.collect()} == {(k, 1.5) for k in range(4)}


def test_scaler_adds_up_panes_before_the_join(spark):
    """Every grid row met its weight; now a row per pane does."""
    aligned = spark.range(240).select(F.lit(0).alias("run"), F.lit("a").alias("channel"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("value"))
    windows = spark.range(50).select(F.lit(0).alias("run"), F.col("id").alias("w"))
    plan = Wn.fit_scaler(aligned, windows, WindowSpec(window=12, stride=4, horizon=2))._jdf.queryExecution().optimizedPlan().toString()
    assert "_ss" in plan.split("Join Inner", 1)[1]
