"""Training, baselines, streaming forms and the sealed protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.functions.numeric import rounded
from gridwake.models import features as Ft
from gridwake.models import training as Tr
from gridwake.models import var1 as Va
from gridwake.operators import grid as G
from gridwake.operators import metrics as M
from gridwake.operators import protocol as Pc
from gridwake.operators import splits as Sp
from gridwake.operators import windows as Wn
from gridwake.plans.quantiles import quantile_higher, top_mean
from gridwake.queries.calibration import edges_of, normal, residuals_of
from gridwake.queries.features import _CHRONO, described_of
from gridwake.queries.grid import filled_of, labelled_of, windows_of
from gridwake.queries.metrics import _CLS, _CLS_COLS, SC, class_cte, preds_of
from gridwake.queries.registry import HOUR_US, SPEC, STEP_US, TOPICS, Tables, query, topic_expr
from gridwake.queries.sqlkit import r, sql
from gridwake.session import shared_dir, stage
from gridwake.streaming import gates as St

W, ST = SPEC.window, SPEC.stride


def store_of(t: Tables, described=None):
    """Feature store: vector, binary label, class and split of every window."""
    points = labelled_of(t)
    wins = Wn.window_class(Wn.window_label(windows_of(t), points, SPEC), points, SPEC)
    vec = Ft.window_vectors(described_of(t) if described is None else described)
    rows = Sp.split_chrono(wins).join(vec, ["run", "w"])
    return stage(rows.select(F.col("run").alias("group"), F.col("w").alias("start"), "label", "class_id", "split", "features"))


def split(store, name: str):
    return store.filter(F.col("split") == name)


_DESC = ", ".join(f"({k}, '{d}')" for k, d in enumerate(Wn.DESCRIPTORS))


@query(
    "c17_feature_dictionary",
    f"""WITH ch AS (SELECT event_type AS channel, row_number() OVER (ORDER BY event_type) - 1 AS c, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events))
    SELECT (k * n + c)::INT AS feature_index, d || '__' || channel AS feature, d AS descriptor, channel, CASE {' '.join(f"WHEN channel = '{c}' THEN '{x}'" for c, x in TOPICS.items())} END AS topic
    FROM ch, (VALUES {_DESC}) AS v(k, d)""",
)
def _(t: Tables):
    return Ft.feature_dictionary(t.events.select(F.col("event_type").alias("channel")), topic_expr())


@query("n1_binary_boosting")
def _(t: Tables):
    s = store_of(t)
    model = Tr.fit_binary(split(s, "train"), split(s, "validation"), 0, trees=5, depth=3)
    thr = Tr.frozen_threshold(stage(Tr.score_binary(model, split(s, "validation"))))
    return Tr.evaluate_scores(stage(Tr.score_binary(model, split(s, "test"))), thr)


@query("n2_binary_forest")
def _(t: Tables):
    s = store_of(t)
    model = Tr.fit_forest(split(s, "train"), 0, trees=8, depth=4)
    thr = Tr.frozen_threshold(stage(Tr.score_binary(model, split(s, "validation"))))
    return Tr.evaluate_scores(stage(Tr.score_binary(model, split(s, "test"))), thr)


@query("n3_stage2_multiclass")
def _(t: Tables):
    s = store_of(t)
    sub = s.filter("label = 1").withColumn("class_id", F.col("class_id") - 1)
    out = None
    for name, boosted in (("boosted", True), ("forest", False)):
        model = Tr.fit_multiclass(split(sub, "train"), 0, trees=3, depth=3, boosted=boosted)
        preds = Tr.predict_classes(model, split(sub, "test")).withColumnRenamed("class_id", "true_class")
        one = M.class_metrics(M.confusion(preds), (0, 1, 2, 3)).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("n4_direct_five_class")
def _(t: Tables):
    s = store_of(t).withColumn("class_id", F.when(F.col("label") == 1, F.col("class_id")).otherwise(F.lit(0)))
    model = Tr.fit_multiclass(split(s, "train"), 0, trees=8, depth=4, boosted=False)
    preds = Tr.predict_classes(model, split(s, "test")).withColumnRenamed("class_id", "true_class")
    return M.class_metrics(M.confusion(preds), (0, 1, 2, 3, 4))


_TRIV = {
    "tr": "SELECT (l_linenumber % 5)::BIGINT AS c, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "cu": "SELECT c, sum(n) OVER (ORDER BY c) AS cum, sum(n) OVER (ORDER BY c) - n AS lo, sum(n) OVER () AS tot FROM tr",
    "te": "SELECT o_orderkey AS key, (o_custkey % 5)::BIGINT AS true_class FROM orders",
}


@query(
    "n5_trivial_baselines",
    sql(
        """SELECT 'majority' AS method, key, true_class, (SELECT c FROM tr ORDER BY n DESC, c LIMIT 1) AS predicted_class FROM te UNION ALL
        SELECT 'stratified_random', key, true_class, c FROM (SELECT *, ('0x' || substr(md5('3:' || key), 1, 8))::BIGINT % (SELECT max(tot) FROM cu) AS u FROM te) JOIN cu ON u >= lo AND u < cum""",
        **_TRIV,
    ),
)
def _(t: Tables):
    train = preds_of(t).filter("method = 'R'").select("true_class")
    test = t.orders.select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 5).cast("long").alias("true_class"))
    return Tr.trivial_baselines(train, test, 3, "key").select("method", "key", "true_class", "predicted_class")


@query(
    "n6_cascade_metrics",
    sql(f"SELECT {_CLS} FROM pm GROUP BY one", pr="SELECT 1 AS one, (o_custkey % 5)::BIGINT AS true_class, CASE WHEN o_totalprice / 500000 >= 0.4 THEN o_custkey % 4 + 1 ELSE 0 END::BIGINT AS predicted_class FROM orders",
        **class_cte("pr", (0, 1, 2, 3, 4), "one")),
)
def _(t: Tables):
    o = t.orders.select(
        F.col("o_orderkey").alias("start"), (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_custkey") % 5).cast("long").alias("true_class"),
        (F.col("o_custkey") % 4 + 1).alias("stage2_class"),
    )
    out = Tr.evaluate_cascade(o.select("start", "score", "true_class"), o.select("start", "stage2_class"), 0.4, ["start"])
    return out.withColumns({c: rounded(c) for c in _CLS_COLS})


@query("n7_zero_shot_transfer")
def _(t: Tables):
    """Train on even users, test on odd ones whose channels go through a name map."""
    d = stage(described_of(t))
    names = {"click": "click", "error": "error", "view": "view"}
    rows = [(k, v) for k, v in names.items()]
    cmap = t.spark.createDataFrame(rows, "channel STRING, target_channel STRING")
    s = store_of(t, Ft.shared_channels(d, cmap))
    src, target = s.filter("group % 2 = 0"), s.filter("group % 2 = 1")
    model = Tr.fit_forest(split(src, "train"), 0, trees=8, depth=4)
    thr = Tr.frozen_threshold(stage(Tr.score_binary(model, split(src, "validation"))))
    return Tr.evaluate_scores(stage(Tr.score_binary(model, target)), thr)


@query("n8_unknown_screening")
def _(t: Tables):
    """Runs of unknown class never reach training; run scores are screened at a normal quantile."""
    s = store_of(t)
    known = s.filter("group % 4 <> 0")
    model = Tr.fit_forest(split(known, "train"), 0, trees=8, depth=4)
    scores = stage(Tr.score_binary(model, s.filter("split <> 'train'")))
    per = stage(top_mean(scores, ["split", "group"], "score", 0.2, "run_score").select("split", "group", F.col("run_score").alias("score")))
    per = per.withColumn("kind", F.when(F.col("group") % 4 == 0, "unknown").otherwise("normal"))
    thr = quantile_higher(per.filter("split = 'validation' AND kind = 'normal'"), "score", 0.9)
    return M.screen_metrics(per.filter("split = 'test'"), thr.select("threshold").scalar())


_VAR = {
    "ch0": "SELECT channel, row_number() OVER (ORDER BY channel) AS ci FROM chan",
    "pt": f"SELECT c.run, c.start_k + p AS k FROM chrono c JOIN wlab l USING (run, w), range({W - 1}) AS v(p) WHERE c.split = 'train' AND l.label = 0",
    "z": "SELECT p.run, p.k, p.n, 0 AS i, 1.0::DOUBLE AS v FROM (SELECT run, k, count(*) AS n FROM pt GROUP BY ALL) p UNION ALL"
    " SELECT p.run, p.k, p.n, c.ci, f.value FROM (SELECT run, k, count(*) AS n FROM pt GROUP BY ALL) p JOIN filled f ON f.run = p.run AND f.k = p.k JOIN ch0 c USING (channel) UNION ALL"
    " SELECT p.run, p.k, p.n, c.ci + 5, f.value FROM (SELECT run, k, count(*) AS n FROM pt GROUP BY ALL) p JOIN filled f ON f.run = p.run AND f.k = p.k + 1 JOIN ch0 c USING (channel)",
}


def var_inputs(t: Tables):
    aligned = stage(filled_of(t))
    steps = stage(Va.wide_steps(aligned))
    wins = stage(Wn.window_label(Sp.split_chrono(windows_of(t)), labelled_of(t), SPEC).select("run", "w", "start_k", "split", "label"))
    points = Va.fit_points(wins.filter("split = 'train' AND label = 0"), SPEC)
    return steps, wins, points.join(steps, ["run", "k"])


@query(
    "n9_var1_gram",
    sql("SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(sum(a.v * b.v * a.n), 3) + 0.0 AS s FROM z a JOIN z b ON a.run = b.run AND a.k = b.k GROUP BY ALL", "wins", "wlab", "filled", "chan", **_CHRONO, **_VAR),
)
def _(t: Tables):
    return Va.gram(var_inputs(t)[2]).withColumn("s", rounded("s", 3))


@query("n9_var1_score")
def _(t: Tables):
    steps, wins, fit = var_inputs(t)
    coef, intercept = Va.solve_ridge(Va.gram(fit), 1.0)
    return Va.score_var1(steps, wins.filter("split = 'test'"), coef, intercept, SPEC).select("run", "w", "label", rounded("score").alias("score"))


_PROTO = {
    "pth": "SELECT greatest(0.1::DOUBLE, min(maximum)) AS thr FROM (SELECT maximum FROM mx WHERE run % 2 = 0 ORDER BY maximum DESC LIMIT 2)",
    "pg": "SELECT ws.*, count(*) FILTER (score > thr) OVER (PARTITION BY run ORDER BY w ROWS 2 PRECEDING) = 3 AS gate FROM ws, pth",
    "pe": "SELECT t.run, t.topic, coalesce(avg(greatest(t.value - thr, 0)) FILTER (g.gate), 0) AS evidence FROM top t JOIN pg g USING (run, w), pth GROUP BY ALL",
    "pm": "SELECT e.run, a.module, round(sum(e.evidence * a.weight), 9) AS score FROM pe e JOIN alloc a USING (topic) GROUP BY ALL",
    "pk": "SELECT run, module, CASE WHEN score > 1e-12 THEN (SELECT count(*) FROM pm o WHERE o.run = m.run AND o.score >= m.score - 1e-12) END AS rank FROM pm m",
    "tru": "SELECT DISTINCT run, CASE WHEN run % 2 = 1 THEN 'fault' ELSE 'normal' END AS condition, run // 2 AS pair, run % 3 AS source,"
    " 'src/modules/' || ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][run % 5 + 1] AS truth FROM pg",
    "pa": "SELECT run, condition, pair, source, truth, bool_or(gate) AS any_alarm, bool_or(gate AND t >= 240) AS detected, bool_or(gate AND t < 240) AS pre_onset_alarm,"
    " min(t) FILTER (gate AND t >= 240) - 240 AS delay_s FROM pg JOIN tru USING (run) GROUP BY ALL",
    "pl": "SELECT k.run, min(k.rank) FILTER (k.module = a.truth AND a.detected) AS tr, count(DISTINCT k.module) AS m FROM pk k JOIN pa a USING (run) WHERE a.condition = 'fault' GROUP BY k.run",
}


@query(
    "h22_protocol",
    sql(
        f"""SELECT * EXCLUDE (one), {r("detected_runs / fault_runs", "detector_recall")}, fault_runs - detected_runs AS misses FROM (SELECT 1 AS one,
        count(*) FILTER (condition = 'fault') AS fault_runs, count(*) FILTER (condition = 'fault' AND detected) AS detected_runs, count(*) FILTER (condition = 'normal') AS normal_runs,
        count(*) FILTER (condition = 'normal' AND any_alarm) AS normal_alarm_runs, count(DISTINCT source) FILTER (condition = 'normal' AND any_alarm) AS normal_alarm_sources,
        count(*) FILTER (condition = 'fault' AND pre_onset_alarm) AS pre_onset_runs, count(*) FILTER (condition = 'fault' AND detected AND NOT pre_onset_alarm
          AND EXISTS (SELECT 1 FROM pa n WHERE n.pair = pa.pair AND n.condition = 'normal' AND NOT n.any_alarm)) AS clean_detections,
        {r("min(delay_s) FILTER (condition = 'fault' AND detected)", "delay_min_s")}, {r("max(delay_s) FILTER (condition = 'fault' AND detected)", "delay_max_s")} FROM pa)
        JOIN (SELECT 1 AS one, {r("avg(coalesce(1.0 / tr, 0))", "mrr")}, {r("avg(coalesce(tr / m, 1))", "exam")}, {r("avg(coalesce((tr <= 1)::INT, 0))", "top1")},
        {r("avg(coalesce((tr <= 3)::INT, 0))", "top3")}, {r("avg(coalesce((tr <= 5)::INT, 0))", "top5")} FROM pl) USING (one)""",
        "ws", "top", "mx", "alloc", **_PROTO,
    ),
)
def _(t: Tables):
    res = residuals_of(t)
    run = F.col("run")
    modules = F.array(*[F.lit(f"src/modules/{n}") for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
    truth = res.select("run").distinct().select(
        "run", F.when(run % 2 == 1, "fault").otherwise("normal").alias("condition"), F.floor(run / 2).cast("long").alias("pair"),
        (run % 3).alias("source"), F.element_at(modules, (run % 5 + 1).cast("int")).alias("truth"),
    )
    out = Pc.run_protocol(res, normal(res), edges_of(t), truth, 240.0, 0.1)
    cols = ("detector_recall", "delay_min_s", "delay_max_s", "mrr", "exam", "top1", "top3", "top5")
    return out.withColumns({c: rounded(c) for c in cols})


def event_stream(t: Tables):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.path)


def arrive(t: Tables, rows, start, parts: int = 4) -> None:
    """Let the rows arrive in time order in `parts` portions; after each, `start(stream)` runs from its checkpoint until it has caught up."""
    inbox = shared_dir(t.spark)
    cuts = [-float("inf"), *rows.approxQuantile("t", [k / parts for k in range(1, parts)], 0.01), float("inf")]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows.filter((F.col("t") >= low) & (F.col("t") < high)).write.mode("append").parquet(inbox)
        start(t.spark.readStream.schema(rows.schema).parquet(inbox)).awaitTermination()


def drain(t: Tables, stream):
    """Run a stream over what is there now and read back what it wrote."""
    out = shared_dir(t.spark)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(
    "m1_stream_gate",
    """SELECT user_id AS run, event_id AS seq, count(*) FILTER (value > 30) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) = 3 AS gate FROM events""",
)
def _(t: Tables):
    rows = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("score"))
    out = shared_dir(t.spark)
    arrive(t, rows, lambda s: St.stream_gate(s, out, 30.0, 3).trigger(availableNow=True).start())
    return St.read_gates(t.spark, out)


def drained_late(t: Tables, rows, build, delay_us: int):
    """Drain `build(stream)` over the rows in time order, then over rows that come too late, then over two that close all windows.

    The late rows are the first quarter once more under other keys, older than the watermark of `delay_us`
    by far. The closing rows carry the run -1; the first moves the watermark and the second makes Spark
    use it.
    """
    inbox, out = shared_dir(t.spark), shared_dir(t.spark)
    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    width = (ends.high - ends.low) / 4
    late = rows.filter(F.col("ts") < F.lit(ends.low + width)).withColumn("run", F.lit(-2).cast("long"))

    def closing(k: int):
        far = F.lit(ends.high) + F.make_interval(secs=F.lit(10 * delay_us / 1e6 + 86400.0 * 400 * (k + 1)))
        return rows.limit(1).withColumns({"run": F.lit(-1).cast("long"), "ts": far.cast("timestamp")})

    quarters = [rows.filter((F.col("ts") >= F.lit(ends.low + width * k)) & ((F.col("ts") < F.lit(ends.low + width * (k + 1))) if k < 3 else F.lit(True))) for k in range(4)]
    for part in [*quarters, late, closing(0), closing(1)]:
        part.write.mode("append").parquet(inbox)
        stream = build(t.spark.readStream.schema(rows.schema).parquet(inbox))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows")
        query.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows").filter("run <> -1")


@query(
    "m2_sliding_descriptors",
    f"""SELECT run, channel, s AS start_us, s + 86400000000 AS end_us, count(*) AS n, {r("avg(value)", "mean")}, {r("stddev_pop(value)", "std")}, {r("min(value)", "min")}, {r("max(value)", "max")}, {r("max(value) - min(value)", "range")}
    FROM (SELECT user_id AS run, event_type AS channel, value, (epoch_us(ts) // 21600000000 - d) * 21600000000 AS s FROM events, range(4) AS x(d)) GROUP BY ALL""",
)
def _(t: Tables):
    e = t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = drained_late(t, e, lambda s: St.stream_descriptors(s, "24 hours", "6 hours", "1 hour"), HOUR_US)
    return out.select(
        "run", "channel", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n",
        *[rounded(c).alias(c) for c in ("mean", "std", "min", "max", "range")],
    )


@query("m3_stream_dedupe", "SELECT DISTINCT user_id AS run, event_type AS channel, epoch_us(ts) // 86400000000 AS day FROM events")
def _(t: Tables):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("long")
    rows = t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("channel"), F.timestamp_seconds(day * 86400).alias("ts"))
    out = drained_late(t, rows, lambda s: St.stream_dedupe(s, "2 days"), 48 * HOUR_US)
    return out.select("run", "channel", (F.unix_micros("ts") / 86400000000).cast("long").alias("day"))


@query(
    "m4_stream_label",
    sql(
        f"""SELECT e.run, e.seq, e.k, l.label, l.class_id FROM (SELECT t.run, t.seq, (t.ts_us - b.start_us) // {STEP_US} AS k FROM tel t JOIN bounds b USING (run)) e JOIN labelled l ON l.run = e.run AND l.k = e.k""",
        "tel", "bounds", "labelled",
    ),
)
def _(t: Tables):
    bounds = stage(t.bounds())
    points = stage(G.interval_points(t.intervals(), bounds, STEP_US))
    s = event_stream(t).select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    s = s.join(bounds.select("run", "start_us"), "run")
    s = s.withColumn("k", F.floor((F.col("ts_us") - F.col("start_us")) / STEP_US).cast("long")).select("run", "seq", "k")
    return drain(t, St.stream_label(s, points))


@query(
    "m5_alarm_sessions",
    """SELECT run, min(t) AS first_us, max(t) AS last_us, count(*) AS alarms FROM (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY t, event_id) AS sid FROM
    (SELECT *, (coalesce(t - lag(t) OVER (PARTITION BY run ORDER BY t, event_id) >= 21600000000, true))::INT AS nw FROM (SELECT user_id AS run, epoch_us(ts) AS t, event_id FROM events WHERE value > 60))) GROUP BY run, sid""",
)
def _(t: Tables):
    a = t.events.filter("value > 60").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"))
    out = drained_late(t, a, lambda s: St.alarm_sessions(s, "6 hours", "1 hour"), HOUR_US)
    return out.select("run", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "alarms")


__all__ = ["SC"]
