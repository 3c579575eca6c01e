"""Detection, classification, event and alarm metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.functions.numeric import rounded
from gridwake.operators import events as E
from gridwake.operators import labels as L
from gridwake.operators import metrics as M
from gridwake.plans.quantiles import quantile_higher, top_mean
from gridwake.queries.registry import Tables, query
from gridwake.queries.sqlkit import r, sql
from gridwake.session import stage

CLASSES = (0, 1, 2, 3, 4)


def event_scores_of(t: Tables):
    return t.events.select(
        F.col("user_id").alias("group"), F.col("event_id").alias("start"), F.col("value").alias("score"),
        (F.col("event_type") == "error").cast("long").alias("label"),
    )


def line_scores_of(t: Tables):
    return t.lineitem.select(
        F.col("l_suppkey").alias("group"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("long").alias("label"),
    )


def preds_of(t: Tables):
    tax = F.round(F.col("l_tax") * 100).cast("int")
    truth = (F.col("l_linenumber") % 5).cast("long")
    guess = F.when(tax % 3 != 0, truth).otherwise(F.col("l_quantity").cast("long") % 5)
    return t.lineitem.select(
        F.col("l_suppkey").alias("group"), F.col("l_orderkey").alias("start"), F.col("l_returnflag").alias("method"),
        truth.alias("true_class"), guess.alias("predicted_class"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("line"),
    )


SC = {
    "ev": "SELECT user_id AS \"group\", event_id AS start, value AS score, (event_type = 'error')::BIGINT AS label FROM events",
    "ls": "SELECT l_suppkey AS \"group\", l_discount AS score, (l_returnflag = 'R')::BIGINT AS label FROM lineitem",
    "pr": "SELECT l_suppkey AS \"group\", l_orderkey AS start, l_returnflag AS method, (l_linenumber % 5)::BIGINT AS true_class, CASE WHEN round(l_tax * 100)::INT % 3 <> 0"
    " THEN l_linenumber % 5 ELSE l_quantity::BIGINT % 5 END::BIGINT AS predicted_class, l_discount AS score, l_linenumber AS line FROM lineitem",
}


def curve(source: str, by: str = "") -> dict[str, str]:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return {
        "pts": f"SELECT {keys}score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY ALL",
        "cv": f"SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(n) OVER ({part}ORDER BY score DESC) AS seen,"
        f" sum(pos) OVER ({part.strip()}) AS p, sum(n) OVER ({part.strip()}) AS tot FROM pts",
    }


@query(
    "g1_average_precision",
    sql(f"""SELECT 'all' AS scope, {r("sum(pos * tp / seen) / max(p)", "auprc")} FROM cv UNION ALL SELECT "group"::VARCHAR, {r("sum(pos * tp / seen) / nullif(max(p), 0)")} FROM cvg GROUP BY "group" """,
        ev=SC["ev"], **curve("ev"), **{k + "g": v.replace("FROM pts", "FROM ptsg") for k, v in curve("ev", '"group"').items()}),
)
def _(t: Tables):
    s = event_scores_of(t)
    whole = M.average_precision(s).select(F.lit("all").alias("scope"), rounded("auprc").alias("auprc"))
    per = M.average_precision(s, ["group"]).select(F.col("group").cast("string").alias("scope"), rounded("auprc").alias("auprc"))
    return whole.unionByName(per)


@query(
    "g2_auroc",
    sql(f"""SELECT "group", {r("sum((n - pos) * (tp - pos + 0.5 * pos))::DOUBLE / nullif(max(p) * (max(tot) - max(p)), 0)", "auroc")} FROM cv GROUP BY "group" """,
        ls=SC["ls"], **curve("ls", '"group"')),
)
def _(t: Tables):
    return M.auroc(line_scores_of(t), ["group"]).withColumn("auroc", rounded("auroc"))


@query(
    "g3_best_f1",
    sql(f"""SELECT {r("max(f1)", "best_f1")}, {r("min(score) FILTER (f1 = m)", "threshold")} FROM (SELECT *, max(f1) OVER () AS m FROM
        (SELECT score, 2.0 * (tp / seen) * (tp / p) / greatest(tp / seen + tp / p, 1e-12) AS f1 FROM cv))""", ev=SC["ev"], **curve("ev")),
)
def _(t: Tables):
    return M.best_f1(event_scores_of(t)).select(rounded("best_f1").alias("best_f1"), rounded("threshold").alias("threshold"))


@query(
    "g4_point_metrics",
    sql(f"""SELECT "group", {r('''coalesce(2.0 * count(*) FILTER (score >= 60 AND label = 1) / nullif(count(*) FILTER (score >= 60) + sum(label), 0), 0)''', "f1")},
        {r("avg((score >= 60)::INT)", "positive_rate")}, count(*) AS n FROM ev GROUP BY "group" """, ev=SC["ev"]),
)
def _(t: Tables):
    out = M.point_metrics(event_scores_of(t), F.lit(60.0), ["group"])
    return out.withColumns({"f1": rounded("f1"), "positive_rate": rounded("positive_rate")})


def _walk(by_group: bool) -> dict[str, str]:
    """Two-pointer walk over sorted event lists as a recursive query."""
    pos = 'PARTITION BY "group" ORDER BY start' if by_group else 'ORDER BY "group", start'
    grp = '"group"' if by_group else "0"
    seg = (
        "SELECT g, {x} AS flag_no, min(i) AS a, max(i) AS b, row_number() OVER (PARTITION BY g ORDER BY min(i)) AS no FROM (SELECT g, i, {f},"
        " sum(CASE WHEN {f} AND NOT coalesce(lagged, false) THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY i) AS {x} FROM"
        " (SELECT *, lag({f}) OVER (PARTITION BY g ORDER BY i) AS lagged FROM rw)) WHERE {f} GROUP BY g, {x}"
    )
    return {
        "rw": f"SELECT {grp} AS g, row_number() OVER ({pos}) AS i, label = 1 AS lab, score >= 60 AS hit FROM ev",
        "ts": seg.format(f="lab", x="tn"),
        "ps": seg.format(f="hit", x="pn"),
        "cnt": "SELECT r.g, coalesce((SELECT count(*) FROM ts WHERE ts.g = r.g), 0) AS true_events, coalesce((SELECT count(*) FROM ps WHERE ps.g = r.g), 0) AS pred_events FROM (SELECT DISTINCT g FROM rw) r",
    }


def _walk_sql(by_group: bool, select: str) -> str:
    parts = {"ev": SC["ev"], **_walk(by_group)}
    body = ", ".join(f"{n} AS ({b})" for n, b in parts.items())
    walk = (
        "wk AS (SELECT g, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS m FROM cnt UNION ALL"
        " SELECT k.g, CASE WHEN p.a <= t.b AND t.a <= p.b THEN k.i + 1 WHEN p.b < t.a THEN k.i ELSE k.i + 1 END,"
        " CASE WHEN p.a <= t.b AND t.a <= p.b THEN k.j + 1 WHEN p.b < t.a THEN k.j + 1 ELSE k.j END,"
        " k.m + (p.a <= t.b AND t.a <= p.b)::BIGINT FROM wk k JOIN ts t ON t.g = k.g AND t.no = k.i JOIN ps p ON p.g = k.g AND p.no = k.j)"
    )
    return f"WITH RECURSIVE {body}, {walk} {select}"


@query(
    "g5_event_f1_by_run",
    _walk_sql(True, 'SELECT c.g AS "group", true_events, pred_events, max(m) AS matched FROM cnt c JOIN wk USING (g) GROUP BY ALL'),
)
def _(t: Tables):
    return E.event_f1(event_scores_of(t), 60.0)


_EVENT_SUM = (
    "SELECT *, {p}, {q}, {f} FROM (SELECT sum(true_events)::BIGINT AS true_events, sum(pred_events)::BIGINT AS pred_events, sum(matched)::BIGINT AS matched FROM"
    " (SELECT c.g, true_events, pred_events, max(m) AS matched FROM cnt c JOIN wk USING (g) GROUP BY ALL))"
).format(
    p=r("matched / greatest(1, pred_events)", "event_precision"),
    q=r("matched / greatest(1, true_events)", "event_recall"),
    f=r("2.0 * (matched / greatest(1, pred_events)) * (matched / greatest(1, true_events)) / greatest(matched / greatest(1, pred_events) + matched / greatest(1, true_events), 1e-12)", "event_f1"),
)


@query("g6_event_f1_log_aware", _walk_sql(True, _EVENT_SUM))
def _(t: Tables):
    out = E.event_scores(E.event_f1(event_scores_of(t), 60.0))
    return out.withColumns({c: rounded(c) for c in ("event_precision", "event_recall", "event_f1")})


@query("g6_event_f1_pooled", _walk_sql(False, _EVENT_SUM))
def _(t: Tables):
    out = E.event_scores(E.event_f1(event_scores_of(t), 60.0, by=()))
    return out.withColumns({c: rounded(c) for c in ("event_precision", "event_recall", "event_f1")})


@query(
    "k3_event_segments",
    """SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY a) AS segment, a AS first, b AS last, n AS length FROM
    (SELECT "group", min(start) AS a, max(start) AS b, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) -
      row_number() OVER (PARTITION BY user_id, value >= 60 ORDER BY event_id) AS isl, user_id AS "group", event_id AS start FROM events) WHERE value >= 60 GROUP BY "group", isl)""",
)
def _(t: Tables):
    rows = event_scores_of(t).withColumn("hit", F.col("score") >= 60)
    return E.segments(rows, "hit", ["group"], 1 << 16)


@query("g7_confusion", sql("SELECT method, true_class, predicted_class, count(*) AS n FROM pr GROUP BY ALL", pr=SC["pr"]))
def _(t: Tables):
    return M.confusion(preds_of(t), ["method"])


def class_cte(source: str, labels, by: str) -> dict[str, str]:
    lab = ", ".join(f"({c})" for c in labels)
    return {
        "lb": f"SELECT * FROM (VALUES {lab}) AS v(class_id)",
        "pc": f"SELECT {by}, lb.class_id::BIGINT AS class_id, count(*) FILTER (true_class = lb.class_id AND predicted_class = lb.class_id) AS tp,"
        f" count(*) FILTER (predicted_class = lb.class_id) AS pp, count(*) FILTER (true_class = lb.class_id) AS support,"
        f" avg((true_class = predicted_class)::INT) AS acc FROM {source} JOIN lb ON true GROUP BY {by}, lb.class_id",
        "pm": f"SELECT {by}, class_id, support, acc, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,"
        " coalesce(2 * tp / nullif(pp + support, 0), 0) AS f1 FROM pc",
    }


_CLS = (
    f"""{r("max(acc)", "accuracy")}, {r("avg(f1)", "macro_f1")}, {r("avg(precision)", "macro_precision")}, {r("avg(recall)", "macro_recall")},
    {r("avg(recall)", "balanced_accuracy")}, {r("sum(f1 * support) / nullif(sum(support), 0)", "weighted_f1")}"""
)
_CLS_COLS = ("accuracy", "macro_f1", "macro_precision", "macro_recall", "balanced_accuracy", "weighted_f1")


@query("g8_class_metrics", sql(f'SELECT "group", {_CLS} FROM pm GROUP BY "group"', pr=SC["pr"], **class_cte("pr", (0, 1, 2, 3, 4, 7), '"group"')))
def _(t: Tables):
    out = M.class_metrics(M.confusion(preds_of(t), ["group"]), (0, 1, 2, 3, 4, 7), ["group"])
    return out.withColumns({c: rounded(c) for c in _CLS_COLS})


@query(
    "g9_per_class_metrics",
    sql(f"SELECT method, class_id, support, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')} FROM pm", pr=SC["pr"], **class_cte("pr", CLASSES, "method")),
)
def _(t: Tables):
    out = M.per_class_metrics(M.confusion(preds_of(t), ["method"]), CLASSES, ["method"])
    return out.select("method", "class_id", "support", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


_PROB = (
    "SELECT label % 4 + 1 AS true_class, c.class_id, list_sum(embedding[(c.class_id - 1) * 16 + 1 : c.class_id * 16]::DOUBLE[]) AS score,"
    " (label % 4 + 1 = c.class_id)::BIGINT AS label FROM embeddings, (VALUES (1), (2), (3), (4)) AS c(class_id)"
)


@query(
    "g10_ovr_metrics",
    sql(f"""SELECT {r("avg(ap)", "macro_ovr_auprc")}, {r("avg(roc)", "macro_ovr_auroc")} FROM (SELECT class_id, sum(pos * tp / seen) / max(p) AS ap,
        sum((n - pos) * (tp - pos + 0.5 * pos))::DOUBLE / (max(p) * (max(tot) - max(p))) AS roc FROM cv GROUP BY class_id)""", prob=_PROB, **curve("prob", "class_id")),
)
def _(t: Tables):
    parts = F.array(
        *[
            F.struct(
                F.lit(c).cast("long").alias("class_id"),
                F.aggregate(F.slice("embedding", (c - 1) * 16 + 1, 16), F.lit(0.0), lambda a, v: a + v.cast("double")).alias("probability"),
            )
            for c in (1, 2, 3, 4)
        ]
    )
    probs = t.embeddings.select((F.col("label") % 4 + 1).alias("true_class"), F.explode(parts).alias("p")).select("true_class", "p.*")
    return M.ovr_metrics(probs).select(*[rounded(c).alias(c) for c in ("macro_ovr_auprc", "macro_ovr_auroc")])


@query("g11_anomaly_only", sql(f"SELECT method, {_CLS} FROM pm GROUP BY method", pr=SC["pr"] + " WHERE l_linenumber % 5 > 0", **class_cte("pr", (1, 2, 3, 4), "method")))
def _(t: Tables):
    out = M.anomaly_only(preds_of(t), by=["method"])
    return out.withColumns({c: rounded(c) for c in _CLS_COLS})


@query(
    "g12_family_metrics",
    sql(f"""SELECT family, {r("sum(pos * tp / seen) / max(p)", "auprc")}, {r("sum((n - pos) * (tp - pos + 0.5 * pos))::DOUBLE / (max(p) * (max(tot) - max(p)))", "auroc")},
        max(p)::BIGINT AS positives, max(tot)::BIGINT AS rows FROM cv GROUP BY family HAVING max(p) > 0 AND max(p) < max(tot)""",
        fam="SELECT CASE event_type WHEN 'view' THEN 'none' ELSE event_type END AS family, value AS score, (event_type <> 'view' AND value > 20)::BIGINT AS label FROM events",
        fm="SELECT f.family, a.score, a.label FROM fam a JOIN (SELECT DISTINCT family FROM fam WHERE family <> 'none') f ON a.family = f.family OR a.family = 'none'",
        **curve("fm", "family")),
)
def _(t: Tables):
    fam = F.when(F.col("event_type") == "view", "none").otherwise(F.col("event_type"))
    label = ((F.col("event_type") != "view") & (F.col("value") > 20)).cast("long")
    s = t.events.select(fam.alias("family"), F.col("value").alias("score"), label.alias("label"))
    out = M.family_metrics(s)
    return out.withColumns({"auprc": rounded("auprc"), "auroc": rounded("auroc")})


_FLIGHT = """fl AS (SELECT run, kind, split, avg(v) FILTER (rn <= keep) AS score FROM (SELECT user_id AS run, CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE 'normal' END AS kind,
   CASE WHEN user_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn,
   greatest(1, ceil(count(*) OVER (PARTITION BY user_id) * 0.05::DOUBLE)) AS keep FROM events) GROUP BY ALL),
  th AS (SELECT list_sort(list(score))[ceil(0.9::DOUBLE * (count(*) - 1))::BIGINT + 1] AS thr FROM fl WHERE split = 'validation' AND kind = 'normal'),
  cn AS (SELECT count(*) FILTER (kind = 'unknown' AND score > thr) AS tp, count(*) FILTER (kind = 'unknown') AS p, count(*) FILTER (kind = 'normal' AND score > thr) AS fp,
   count(*) FILTER (kind = 'normal') AS neg FROM fl, th WHERE split = 'test')"""


@query(
    "g13_screen_flights",
    f"""WITH {_FLIGHT} SELECT tp, fp, {r("tp / p", "recall")}, {r("(neg - fp) / neg", "specificity")}, {r("2 * tp / (tp + fp + p)", "f1")} FROM cn""",
)
def _(t: Tables):
    s = t.events.select(F.col("user_id").alias("run"), "value")
    flights = stage(top_mean(s, ["run"], "value", 0.05, "score").select("run", "score"))
    flights = flights.withColumns(
        {
            "kind": F.when(F.col("run") % 4 == 0, "unknown").otherwise("normal"),
            "split": F.when(F.col("run") % 3 == 0, "validation").otherwise("test"),
        }
    )
    thr = quantile_higher(flights.filter("split = 'validation' AND kind = 'normal'"), "score", 0.9)
    out = M.screen_metrics(flights.filter("split = 'test'"), thr.select("threshold").scalar())
    return out.withColumns({c: rounded(c) for c in ("recall", "specificity", "f1")})


_RANK = """SELECT o_custkey AS run, 'm' || (l_suppkey % 25) AS module, 'm' || (o_custkey % 25) AS truth, rank() OVER (PARTITION BY o_custkey ORDER BY q DESC) AS rank
   FROM (SELECT o_custkey, l_suppkey % 25 AS l_suppkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def rankings_of(t: Tables):
    """Customers as runs, supplier groups as modules ranked by ordered quantity (at most 25 a run)."""
    from pyspark.sql import Window

    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_custkey").alias("run"), F.concat(F.lit("m"), F.col("l_suppkey") % 25).alias("module")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("run").orderBy(F.col("q").desc())
    return g.select("run", "module", F.concat(F.lit("m"), F.col("run") % 25).alias("truth"), F.rank().over(w).cast("long").alias("rank"))


_LOC = f"""WITH rk AS ({_RANK}), pr AS (SELECT run, truth, min(rank) FILTER (module = truth) AS tr, count(DISTINCT module) AS modules FROM rk GROUP BY ALL)"""


@query(
    "g14_localization_metrics",
    f"""{_LOC} SELECT count(*) AS runs, {r("avg(coalesce(1.0 / tr, 0))", "mrr")}, {r("avg(coalesce(tr / modules, 1))", "exam")}, {r("avg(coalesce((tr <= 1)::INT, 0))", "top1")},
    {r("avg(coalesce((tr <= 3)::INT, 0))", "top3")}, {r("avg(coalesce((tr <= 5)::INT, 0))", "top5")} FROM pr""",
)
def _(t: Tables):
    out = M.localization_metrics(rankings_of(t))
    return out.withColumns({c: rounded(c) for c in ("mrr", "exam", "top1", "top3", "top5")})


_ALARM = """wv AS (SELECT user_id AS run, CASE WHEN user_id % 2 = 0 THEN 'fault' ELSE 'normal' END AS condition, user_id // 2 AS pair, user_id % 3 AS source,
    epoch_us(ts) / 1e6 - 1704067200 AS t, value > CASE WHEN user_id % 2 = 0 THEN 150 ELSE 260 END AS gate FROM events),
  ar AS (SELECT run, condition, pair, source, bool_or(gate) AS any_alarm, bool_or(gate AND t >= 864000) AS detected, bool_or(gate AND t < 864000) AS pre_onset_alarm,
    min(t) FILTER (gate) AS first_alarm_s, min(t) FILTER (gate AND t >= 864000) - 864000 AS delay_s FROM wv GROUP BY ALL)"""


def alarms_of(t: Tables):
    e = t.events
    run = F.col("user_id")
    w = e.select(
        run.alias("run"),
        F.when(run % 2 == 0, "fault").otherwise("normal").alias("condition"),
        F.floor(run / 2).cast("long").alias("pair"),
        (run % 3).alias("source"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("t"),
        (F.col("value") > F.when(run % 2 == 0, 150).otherwise(260)).alias("gate"),
    )
    return M.alarms_by_run(w, 864000.0, ["run", "condition", "pair", "source"])


@query(
    "g15_alarm_summary",
    f"""WITH {_ALARM} SELECT *, {r("detected_runs / fault_runs", "detector_recall")}, fault_runs - detected_runs AS misses FROM (SELECT
    count(*) FILTER (condition = 'fault') AS fault_runs, count(*) FILTER (condition = 'fault' AND detected) AS detected_runs,
    count(*) FILTER (condition = 'normal') AS normal_runs, count(*) FILTER (condition = 'normal' AND any_alarm) AS normal_alarm_runs,
    count(DISTINCT source) FILTER (condition = 'normal' AND any_alarm) AS normal_alarm_sources, count(*) FILTER (condition = 'fault' AND pre_onset_alarm) AS pre_onset_runs,
    count(*) FILTER (condition = 'fault' AND detected AND NOT pre_onset_alarm AND EXISTS (SELECT 1 FROM ar n WHERE n.pair = ar.pair AND n.condition = 'normal' AND NOT n.any_alarm)) AS clean_detections,
    {r("min(delay_s) FILTER (condition = 'fault' AND detected)", "delay_min_s")}, {r("max(delay_s) FILTER (condition = 'fault' AND detected)", "delay_max_s")} FROM ar)""",
)
def _(t: Tables):
    out = M.alarm_summary(alarms_of(t))
    return out.withColumns({c: rounded(c) for c in ("detector_recall", "delay_min_s", "delay_max_s")})


@query(
    "g16_relative_to",
    f"""WITH v AS (SELECT l_returnflag AS variant, l_suppkey AS key, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)
    SELECT variant, key, {r("v.value", "value")}, {r("v.value / b.value", "relative")} FROM v LEFT JOIN (SELECT key, value FROM v WHERE variant = 'N') b USING (key)""",
)
def _(t: Tables):
    v = t.lineitem.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_suppkey").alias("key")).agg(F.avg("l_quantity").alias("value"))
    return M.relative_to(v, "N", "key", "value").withColumns({"value": rounded("value"), "relative": rounded("relative")})


_MAXIMA = """mx AS (SELECT user_id AS run, CASE WHEN user_id % 2 = 0 THEN 'fault' ELSE 'normal' END AS condition, round(max(value)) AS maximum FROM events GROUP BY ALL)"""


def maxima_of(t: Tables):
    run = F.col("user_id")
    return t.events.groupBy(run.alias("run"), F.when(run % 2 == 0, "fault").otherwise("normal").alias("condition")).agg(F.round(F.max("value")).alias("maximum"))


@query(
    "g17_frontier",
    f"""WITH {_MAXIMA}, ct AS (SELECT c AS threshold, count(*) FILTER (condition = 'normal' AND maximum > c) AS normal_alarms, count(*) FILTER (condition = 'fault' AND maximum > c) AS fault_detections
      FROM (SELECT DISTINCT maximum AS c FROM mx UNION SELECT 0.0) JOIN mx ON true GROUP BY c)
    SELECT *, normal_alarms <= 10 AND fault_detections = (SELECT max(fault_detections) FROM ct WHERE normal_alarms <= 10) AS best FROM ct""",
)
def _(t: Tables):
    return M.frontier(maxima_of(t), 10)


@query(
    "g18_separation",
    f"""SELECT event_type AS signal, {r("max(value) FILTER (user_id % 2 = 1)", "normal_max")}, {r("min(m) FILTER (user_id % 2 = 0)", "fault_min")}, {r("max(m) FILTER (user_id % 2 = 0)", "fault_max")}
    FROM (SELECT event_type, user_id, value, max(value) OVER (PARTITION BY event_type, user_id) AS m FROM events) GROUP BY event_type""",
)
def _(t: Tables):
    run = F.col("user_id")
    per = t.events.groupBy(F.col("event_type").alias("signal"), run.alias("run"), F.when(run % 2 == 0, "fault").otherwise("normal").alias("condition")).agg(F.max("value").alias("maximum"))
    return M.separation(per, ["signal"]).withColumns({c: rounded(c) for c in ("normal_max", "fault_min", "fault_max")})


@query(
    "b13_cascade",
    "SELECT o_orderkey AS start, CASE WHEN o_totalprice / 500000 >= 0.5 THEN o_custkey % 4 + 1 ELSE 0 END::BIGINT AS predicted_class FROM orders",
)
def _(t: Tables):
    base = t.orders.select(F.col("o_orderkey").alias("start"), (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_custkey") % 4 + 1).alias("stage2_class"))
    out = L.cascade(base.select("start", "score"), base.select("start", "stage2_class"), 0.5, ["start"])
    return out.select("start", "predicted_class")


@query(
    "b14_gate_counts",
    f"""WITH g AS (SELECT l_returnflag AS scope, l_suppkey AS run, (l_linestatus = 'O')::INT AS truth, l_discount >= 0.06 AS gate FROM lineitem)
    SELECT scope, count(*) FILTER (truth = 1 AND gate) AS tp_windows, count(*) FILTER (truth = 1 AND NOT gate) AS fn_windows, count(*) FILTER (truth = 0 AND gate) AS fp_windows,
    count(*) FILTER (truth = 0 AND NOT gate) AS tn_windows, count(DISTINCT run) FILTER (truth = 1 AND gate) AS tp_runs, count(DISTINCT run) FILTER (truth = 1 AND NOT gate) AS fn_runs,
    count(DISTINCT run) FILTER (truth = 0 AND gate) AS fp_runs, count(DISTINCT run) FILTER (truth = 0 AND NOT gate) AS tn_runs,
    {r("count(*) FILTER (truth = 1 AND gate) / nullif(sum(truth), 0)", "recall")}, {r("count(*) FILTER (truth = 1 AND gate) / nullif(count(*) FILTER (gate), 0)", "precision")} FROM g GROUP BY scope""",
)
def _(t: Tables):
    g = t.lineitem.select(
        F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("run"), (F.col("l_linestatus") == "O").cast("int").alias("truth"), (F.col("l_discount") >= 0.06).alias("gate")
    )
    return M.gate_counts(g, ["scope"]).withColumns({"recall": rounded("recall"), "precision": rounded("precision")})
