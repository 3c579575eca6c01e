"""Hand-computed values of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.catalogue import CHANNELS, EXCLUSION_RULES, PAIR_RULES, PUBLISH_HINTS, SUBSCRIBE_HINTS, TOKEN_RULES, TOPIC_TOKEN
from gridwake.functions.text import first_token, module_of
from gridwake.operators import bootstrap as B
from gridwake.operators import calibration as C
from gridwake.operators import evidence as V
from gridwake.operators import grid as G
from gridwake.operators import labels as L
from gridwake.operators import metrics as M
from gridwake.operators import pairing as P
from gridwake.operators import propagation as Pr
from gridwake.operators import samples as S
from gridwake.operators import source_text as Tx
from gridwake.operators import windows as Wn
from gridwake.models.features import feature_dictionary
from gridwake.plans.panes import WindowSpec, explode_range, window_count, window_starts
from gridwake.plans.quantiles import quantile_higher, top_mean
from gridwake.sources import annotations as A
from gridwake.sources import integrity as N


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_window_count(spark):
    spec = WindowSpec(96, 8, 12)
    got = spark.createDataFrame([(107,), (108,), (116,), (0,)], "rows long").select("rows", window_count("rows", spec).alias("n"))
    assert dict(rows(got)) == {107: 0, 108: 1, 116: 2, 0: 0}


def test_annotation_shapes(spark, tmp_path):
    doc = '{"r1":{"annotations":[{"class":"A","ranges":[["s",[[5,2],[7,9]]],null,["x"],["x",[1]]]},{"class":"B","ranges":[]}]}}'
    (tmp_path / "a.json").write_text(doc)
    docs = A.read_annotations(spark, str(tmp_path))
    assert rows(A.flatten_intervals(docs).select("class", "signal", "start_us", "end_us"), "start_us") == [("A", "s", 2, 5), ("A", "s", 7, 9)]
    assert rows(A.annotation_rows(docs).select("class", "range_index"), "class", "range_index") == [("A", 0), ("A", 1), ("B", None)]
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(Exception, match="object keyed by run"):
        A.read_annotations(spark, str(tmp_path)).collect()


def test_gate_opens_on_kth_crossing(spark):
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.9, 0.9, 0.9, 0.1, 0.9, 0.9])], "run long, w long, score double")
    got = rows(C.sustained_gate(s, F.lit(0.5), 3).select("w", "gate"), "w")
    assert [g for _, g in got] == [False, False, True, False, False, False]


def test_higher_quantile_and_top_mean(spark):
    s = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert quantile_higher(s, "v", 0.5).first()["threshold"] == 3.0
    f = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.9), (1, 0.3), (1, 0.4)], "g long, v double")
    got = {r["g"]: r["top_mean"] for r in top_mean(f, ["g"], "v", 0.34).collect()}
    assert got[0] == pytest.approx(0.55) and got[1] == pytest.approx(0.4)


def test_conservative_rank(spark):
    s = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", 0.0)], "m string, score double")
    assert rows(Pr.conservative_rank(s, []).select("m", "rank"), "m") == [("a", 2), ("b", 2), ("c", 3), ("d", None)]


def test_horizon_labels(spark):
    spec = WindowSpec(4, 2, 2)
    runs = spark.createDataFrame([(0, 12)], "run long, rows long")
    points = spark.createDataFrame([(0, k, int(k == 7)) for k in range(12)], "run long, k long, label long")
    got = rows(Wn.window_label(window_starts(runs, spec), points, spec).select("w", "label"), "w")
    assert [v for _, v in got] == [0, 1, 1, 1]


def test_descriptors_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    spec = WindowSpec(12, 4, 2)
    aligned = spark.createDataFrame(
        [(0, c, k, 40, float(x[k] if c == "a" else 2.0)) for c in "ab" for k in range(40)], "run long, channel string, k long, rows long, value double"
    )
    got = {(r["channel"], r["w"]): r["d"] for r in Wn.descriptors(aligned, spec).collect()}
    assert len(got) == 2 * 7
    for w in range(7):
        s = x[4 * w:4 * w + 12]
        d = np.diff(s)
        lag = ((s[1:] - s.mean()) * (s[:-1] - s.mean())).mean() / max(s[1:].std() * s[:-1].std(), 1e-6)
        want = [s.mean(), s.std(), s.min(), s.max(), np.ptp(s), *np.quantile(s, [0.1, 0.25, 0.5, 0.75, 0.9]), s[0], s[-1], s[-1] - s[0],
                d.mean(), d.std(), np.abs(d).mean(), np.abs(d).max(), lag]
        np.testing.assert_allclose(got["a", w], want, atol=1e-9)
    assert got["b", 0][0] == 2.0 and np.isfinite(got["b", 0]).all()


def test_scaler_weights_samples_by_coverage(spark):
    x = np.random.default_rng(1).normal(size=30)
    spec = WindowSpec(8, 4, 2)
    aligned = spark.createDataFrame([(0, "a", k, 30, float(x[k])) for k in range(30)], "run long, channel string, k long, rows long, value double")
    train = spark.createDataFrame([(0, w) for w in range(3)], "run long, w long")
    got = Wn.fit_scaler(aligned, train, spec).first()
    cover = np.concatenate([x[4 * w:4 * w + 8] for w in range(3)])
    assert (got["n"], got["mean"], got["std"]) == (24, pytest.approx(cover.mean()), pytest.approx(cover.std()))


def test_gap_support(spark):
    pts = [0.0, 0.1, 0.2, 0.3, 10.3, 10.4, 10.5, 10.6]
    tel = spark.createDataFrame([(0, "a", int(p * 1e6), 1.0) for p in pts], "run long, channel string, ts_us long, value double")
    grid = spark.createDataFrame([(0, i, int(p * 1e6), 5) for i, p in enumerate([-0.1, 0.1, 5.0, 10.5, 12.0])], "run long, k long, ts_us long, rows long")
    got = rows(G.resample_supported(tel, grid, ["a"], 3_000_000).select("k", "valid"), "k")
    assert [v for _, v in got] == [False, True, False, True, False]


def test_interpolation_never_extrapolates(spark):
    t = spark.createDataFrame([(0, i, ts, 0.0) for i, ts in enumerate([0, 1, 2, 3])], "run long, w long, ts_us long, value double")
    ref = spark.createDataFrame([(0, 1, 10.0), (0, 3, 30.0)], "run long, ts_us long, value double")
    sup = spark.createDataFrame([(0, 2, 9)], "run long, target_end long, reference_end long")
    got = P.interp_join(t, ref, ["run"], 2, sup, ["run"])
    assert rows(got.select("ts_us", "matched"), "ts_us") == [(1, 10.0), (2, 20.0)]
    with pytest.raises(Exception, match="too few common windows"):
        P.matched_residual(t, ref, ["run"], 2, sup, ["run"]).collect()


def test_calibration_fails_closed(spark):
    scores = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "run string, maximum double")
    assert rows(C.fit_second_largest(scores)) == [(3.0,)]
    for wrong, message in (
        (lambda: quantile_higher(scores.limit(0), "maximum", 0.9), "no maximum to calibrate on"),
        (lambda: quantile_higher(scores.union(spark.createDataFrame([("c", float("nan"))], "run string, maximum double")), "maximum", 0.9), "not finite"),
        (lambda: C.fit_second_largest(scores.limit(1)), "two normal runs required"),
        (lambda: C.fit_event_threshold_quantile(spark.createDataFrame([("a", 0, 20.0, 1.0)], "run string, w long, t double, score double")), "no maximum to calibrate on"),
        (lambda: M.score_curve(spark.createDataFrame([(1, float("nan")), (0, 1.0)], "label long, score double")), "must be finite"),
    ):
        with pytest.raises(Exception, match=message):
            wrong().collect()


def test_rows_without_calibration_fail(spark):
    res = spark.createDataFrame([("a", 1.0), ("b", 99.0)], "feature string, residual double")
    noise = spark.createDataFrame([("a", 0.5)], "feature string, noise double")
    with pytest.raises(Exception, match="feature without noise"):
        C.scaled_residual(res, noise).collect()
    assert rows(C.scaled_residual(res.filter("feature = 'a'"), noise).select("scaled")) == [(2.0,)]
    t = spark.createDataFrame([(0, 0, 5, 1.0), (1, 0, 5, 1.0)], "run long, w long, ts_us long, value double")
    ref = spark.createDataFrame([(0, 5, 1.0), (1, 50, 1.0)], "run long, ts_us long, value double")
    sup = spark.createDataFrame([(0, 99, 99), (1, 99, 99)], "run long, target_end long, reference_end long")
    with pytest.raises(Exception, match="too few common windows"):
        P.matched_residual(t, ref, ["run"], 10, sup, ["run"], min_windows=1).collect()
    found = P.residual_rows(t, ref, ["run"], 10, sup, ["run"])
    counts = P.window_counts(found, sup, ["run"])
    assert rows(counts, "run") == [(0, 1), (1, 0)]
    assert rows(P.require_windows(found, counts.filter("windows > 0"), ["run"], 1).select("run")) == [(0,)]


def test_reversed_bounds_give_no_grid(spark):
    df = spark.createDataFrame([(0, 0), (1, -3), (2, 2)], "run long, n long")
    assert rows(explode_range(df, "n", "k").select("run", "k"), "k") == [(2, 0), (2, 1)]


def test_shape_and_time_checks(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 1)], "run long, ts_us long")
    assert S.require_shape(df, ["run"], 2).count() == 4
    with pytest.raises(Exception, match="without exactly 3 rows"):
        S.require_shape(df, ["run"], 3).collect()
    assert S.require_increasing(df.filter("run = 0"), ["run"]).count() == 2
    with pytest.raises(Exception, match="does not increase"):
        S.require_increasing(df, ["run"]).collect()


def test_feature_dictionary(spark):
    got = rows(feature_dictionary(spark.createDataFrame([("b.y",), ("a.x",), ("a.x",)], "channel string")), "feature_index")
    assert len(got) == 2 * len(Wn.DESCRIPTORS)
    assert got[:3] == [(0, "mean__a.x", "mean", "a.x", "a"), (1, "mean__b.y", "mean", "b.y", "b"), (2, "std__a.x", "std", "a.x", "a")]


def test_clock_recovery(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(50, 2)).astype("float32")
    src = spark.createDataFrame([(0, 900_000 + i * 1000, float(a), float(b), i) for i, (a, b) in enumerate(data)], "run long, ts_us long, a double, b double, seq long")
    rep = src.filter("seq >= 3").withColumn("ts_us", F.col("ts_us") - 500_000)
    org = spark.createDataFrame([(0, 900_000)], "run long, origin_us long")
    got = P.clock_offset(src, rep, org, ["a", "b"]).first()
    assert (got["origin_us"], got["matches"], got["max_deviation_us"]) == (400_000, 47, 0)
    with pytest.raises(Exception, match="insufficient unique clock anchors"):
        same = src.withColumns({"a": F.lit(1.0), "b": F.lit(1.0)})
        P.clock_offset(same, rep, org, ["a", "b"]).collect()


def test_bank_scale_unavailable(spark):
    h = spark.createDataFrame([("a", 2.0, True)] * 3 + [("b", 2.0, True)] * 2, "channel string, distance double, valid boolean")
    assert rows(C.bank_scale(h), "channel") == [("a", 2.0, 3), ("b", None, 2)]


def test_average_precision_with_ties(spark):
    y, s = [0, 1, 0, 1, 1], [0.1, 0.9, 0.2, 0.8, 0.7]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label long, score double")
    assert M.average_precision(df).first()["auprc"] == pytest.approx(1.0)
    tied = df.withColumn("score", F.lit(1.0))
    assert M.average_precision(tied).first()["auprc"] == pytest.approx(0.6)
    assert M.auroc(tied).first()["auroc"] == pytest.approx(0.5)


def test_macro_f1_counts_absent_labels(spark):
    conf = spark.createDataFrame([(0, 0, 2), (1, 0, 2)], "true_class long, predicted_class long, n long")
    assert M.class_metrics(conf, (0, 1)).first()["macro_f1"] == pytest.approx(1 / 3)


def test_localization(spark):
    r = spark.createDataFrame(
        [("a", "m1", "m1", 1), ("a", "m2", "m1", 2), ("b", "m1", "m2", 1), ("b", "m2", "m2", 2)], "run string, module string, truth string, rank long"
    )
    got = M.localization_metrics(r).first()
    assert (got["top1"], got["mrr"], got["exam"]) == (0.5, 0.75, 0.75)


def test_hierarchical_label_fails_closed(spark):
    ok = spark.createDataFrame([(0, 9), (1, 3)], "label long, class_id long")
    assert [r["hier_label"] for r in L.hierarchical_label(ok).collect()] == [0, 3]
    with pytest.raises(Exception, match="without a subsystem label"):
        L.hierarchical_label(spark.createDataFrame([(1, 5)], "label long, class_id long")).collect()


def test_propagation_conserves_mass(spark):
    edges = spark.createDataFrame(
        [("t", "publisher", "a"), ("t", "subscriber", "a"), ("t", "subscriber", "b")], "topic string, role string, module string"
    )
    imp = spark.createDataFrame([("all", "t", 3.0)], "scope string, topic string, value double")
    got = rows(Pr.propagate(imp, edges, "bidirectional").select("module", "score"), "module")
    assert got == [("a", 1.5), ("b", 1.5)]


def test_source_edges(spark):
    text = "uORB::Publication<x> p{ORB_ID(alpha)};\nint q = orb_subscribe(ORB_ID(beta));\n" + "y" * 600 + " ORB_ID(gamma)"
    files = spark.createDataFrame([("src/modules/nav/deep/x.cpp", text)], "path string, text string")
    got = rows(Tx.extract_edges(files, TOPIC_TOKEN, PUBLISH_HINTS, SUBSCRIBE_HINTS).select("topic", "role", "module"), "topic")
    assert got == [("alpha", "publisher", "src/modules/nav"), ("beta", "subscriber", "src/modules/nav")]
    audit = rows(Tx.audit_edges(files, TOPIC_TOKEN, PUBLISH_HINTS, SUBSCRIBE_HINTS).select("topic", "line", "reference_role", "role_agreement"), "topic")
    assert ("beta", 2, "subscriber", True) in audit


def test_classifiers(spark):
    df = spark.createDataFrame([(c,) for c in ("vehicle_attitude.yawspeed", "vehicle_local_position.z", "estimator_status.vibe[1]", "vehicle_status.nav_state")], "channel string")
    got = {r["channel"]: (r["a"], r["b"]) for r in df.select("channel", first_token("channel", TOKEN_RULES, "Shared").alias("a"), V.classify_pairs("channel", PAIR_RULES).alias("b")).collect()}
    assert got["vehicle_attitude.yawspeed"] == ("Global Position", "Mechanical/Electrical")
    assert got["vehicle_local_position.z"] == ("Altitude", "Altitude")
    assert got["estimator_status.vibe[1]"][1] == "Mechanical/Electrical" and got["vehicle_status.nav_state"][1] == "Shared"
    assert len(CHANNELS) == len(set(CHANNELS))
    p = spark.createDataFrame([("src/examples/a/b.c",), ("src/lib/x/y/z.c",), ("main.c",)], "path string")
    out = [tuple(r) for r in p.select(module_of("path"), first_token("path", EXCLUSION_RULES, None)).collect()]
    assert out == [("src/examples/a", "examples"), ("src/lib/x", None), (".", None)]


def test_consistency_and_random_baseline(spark):
    ch = spark.createDataFrame(
        [(0, 0, 5.0, 1, 1), (0, 1, 0.0, 2, 1), (1, 0, 1.0, 1, 2), (1, 1, 8.0, 2, 2)], "row long, channel long, value double, channel_class long, true_class long"
    )
    got = V.consistency_at_k(ch, 1).first()
    assert got["consistency"] == 1.0 and got["weighted_consistency"] == pytest.approx((1 + 8 / 9) / 2)
    classes = spark.createDataFrame([(i, 1 if i < 14 else 2) for i in range(87)], "channel long, channel_class long")
    labels = spark.createDataFrame([(1,)], "true_class long")
    assert V.random_consistency(labels, classes, 3).first()["hit_rate"] == pytest.approx(0.413218, abs=1e-6)


def test_bootstrap_weights_sum_to_group_count(spark):
    g = spark.createDataFrame([(i,) for i in range(30)], "group long")
    w = B.bootstrap_weights(g, 5, 1)
    assert {r["s"] for r in w.groupBy("rep").agg(F.sum("weight").alias("s")).collect()} == {30}


def test_sign_flip_limit(spark):
    d = spark.createDataFrame([(1.0,)] * 3, "difference double")
    assert B.sign_flip_p(d).first()["p_value"] == pytest.approx(2 / 8)
    with pytest.raises(ValueError, match="more than 32 clusters"):
        B.sign_flip_p(spark.createDataFrame([(1.0,)] * 33, "difference double")).collect()


def test_validated_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    with pytest.raises(Exception, match="duplicate key"):
        N.join_one_to_one(a.union(a), a, ["k"]).collect()
    with pytest.raises(Exception, match="differs between the sides"):
        N.join_one_to_one(a, a.withColumn("v", F.lit("z")), ["k"], ["v"]).collect()
    with pytest.raises(Exception, match="without a dimension entry"):
        N.join_required(a, a.filter("k = 1").withColumnRenamed("v", "d"), ["k"]).collect()


def test_seal_and_manifest(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    digest = N.seal(df, str(tmp_path / "s"))
    assert N.table_digest(df.orderBy(F.col("id").desc()).repartition(7)).first()["digest"] == digest
    assert N.open_sealed(spark, str(tmp_path / "s"), digest).count() == 100
    before = N.hash_manifest(spark, [str(tmp_path / "s" / "rows")])
    before = spark.createDataFrame(before.collect(), before.schema)
    N.assert_unchanged(before, N.hash_manifest(spark, [str(tmp_path / "s" / "rows")]))
    spark.range(1).withColumn("x", F.lit(5).cast("long")).write.mode("append").parquet(str(tmp_path / "s" / "rows"))
    with pytest.raises(ValueError):
        N.open_sealed(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        N.assert_unchanged(before, N.hash_manifest(spark, [str(tmp_path / "s" / "rows")]))
    with pytest.raises(ValueError):
        N.forbid_columns(df.withColumn("truth", F.lit(1)), ["truth"])
