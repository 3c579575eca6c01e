"""Window descriptors, scaling and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.functions.numeric import rounded
from gridwake.operators import inspect as I
from gridwake.operators import samples as S
from gridwake.operators import splits as Sp
from gridwake.operators import windows as Wn
from gridwake.plans.quantiles import top_mean
from gridwake.queries.grid import _STATUS_SQL, _SUPPORT_SQL, filled_of, labelled_of, status_of, supported_of, windows_of
from gridwake.queries.registry import CHANNELS, SPEC, Tables, query
from gridwake.queries.sqlkit import r, sql

W = SPEC.window


def described_of(t: Tables):
    return Wn.descriptors(filled_of(t), SPEC)


@query("e1_window_descriptors", sql(f"SELECT run, channel, w, descriptor, {r('value', 'value')} FROM featlong", "featlong"))
def _(t: Tables):
    return Wn.long_features(described_of(t)).withColumn("value", rounded("value"))


_SLICE = ("mean", "std", "range", "endpoint_delta", "lag1")


@query(
    "minimum_slice",
    sql(
        "SELECT channel, label, count(*) AS windows, "
        + ", ".join(r(f'avg(f."{d}")', f"avg_{d}") for d in _SLICE)
        + " FROM feat f JOIN wlab USING (run, w) GROUP BY channel, label",
        "feat",
        "wlab",
    ),
)
def _(t: Tables):
    d = described_of(t)
    picked = d.select("run", "channel", "w", *[F.col("d")[Wn.DESCRIPTORS.index(n)].alias(n) for n in _SLICE])
    labels = Wn.window_label(windows_of(t), labelled_of(t), SPEC).select("run", "w", "label")
    return (
        picked.join(labels, ["run", "w"])
        .groupBy("channel", "label")
        .agg(F.count(F.lit(1)).alias("windows"), *[rounded(F.avg(n)).alias(f"avg_{n}") for n in _SLICE])
    )


_CHRONO = {
    "cuts": "SELECT *, greatest(1, floor(n_windows * 0.7::DOUBLE))::BIGINT AS te FROM wins",
    "cuts2": "SELECT *, least(n_windows, te + greatest(1, floor(n_windows * 0.15::DOUBLE))::BIGINT) AS ve FROM cuts",
    "chrono": "SELECT run, w, start_k, n_windows, te, ve, CASE WHEN w < te THEN 'train' WHEN w < ve THEN 'validation' ELSE 'test' END AS split FROM cuts2",
}
_SCALER = {
    "cover": f"SELECT a.channel, a.value FROM filled a JOIN chrono c ON a.run = c.run AND c.split = 'train' AND a.k BETWEEN c.start_k AND c.start_k + {W - 1}",
    "scaler": "SELECT channel, count(*) AS n, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END AS std FROM cover GROUP BY channel",
}


def scaler_of(t: Tables):
    train = Sp.split_chrono(windows_of(t)).filter("split = 'train'")
    return Wn.fit_scaler(filled_of(t), train, SPEC)


@query(
    "e2_fit_scaler",
    sql(f"SELECT channel, n, {r('mean', 'mean')}, {r('std', 'std')} FROM scaler", "wins", "filled", **_CHRONO, **_SCALER),
)
def _(t: Tables):
    return scaler_of(t).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query(
    "e3_apply_scaler",
    sql(
        f"SELECT run, channel, k, {r('(value - mean) / std', 'value')} FROM filled JOIN scaler USING (channel)",
        "wins", "filled", **_CHRONO, **_SCALER,
    ),
)
def _(t: Tables):
    z = Wn.apply_scaler(filled_of(t), scaler_of(t))
    return z.select("run", "channel", "k", rounded("value").alias("value"))


@query(
    "e4_channel_coverage",
    sql(
        f"""SELECT channel, count(*) AS runs, {r("count(*) / (SELECT count(*) FROM ur)", "coverage")},
        count(*) / (SELECT count(*) FROM ur) >= 0.6 AS core FROM
        (SELECT run, channel FROM tel WHERE value > 20 GROUP BY ALL HAVING count(DISTINCT ts_us) >= 6 AND stddev_samp(value) > 1e-10)
        JOIN ur USING (run) GROUP BY channel""",
        "tel",
        ur="SELECT run FROM tel GROUP BY run HAVING max(value) > 150",
    ),
)
def _(t: Tables):
    tel = t.telemetry()
    usable = tel.groupBy("run").agg(F.max("value").alias("m")).filter("m > 150").select("run")
    ok = S.admissible_channels(tel.filter("value > 20")).filter("distinct_ts >= 6")
    return S.channel_coverage(ok, usable).withColumn("coverage", rounded("coverage"))


_ANN_SQL = """ann AS (SELECT o_custkey AS run, o_orderkey AS annotation_index, CASE o_orderstatus WHEN 'F' THEN 'Normal' WHEN 'O' THEN 'Altitude'
   ELSE 'Uncategorized' END AS class FROM orders),
  rng AS (SELECT run, annotation_index, class, l_linenumber AS start_us FROM ann LEFT JOIN
   lineitem ON l_orderkey = annotation_index)"""


@query(
    "e5_annotation_stats",
    f"""WITH {_ANN_SQL} SELECT class, count(DISTINCT (run, annotation_index)) AS annotations, count(start_us) AS intervals,
    count(*) FILTER (start_us IS NULL AND class NOT IN ('Normal', 'Uncategorized')) AS without_range FROM rng GROUP BY class""",
)
def _(t: Tables):
    cls = F.when(F.col("o_orderstatus") == "F", "Normal").when(F.col("o_orderstatus") == "O", "Altitude").otherwise("Uncategorized")
    ann = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("annotation_index"), cls.alias("class"))
    ranges = t.lineitem.select(
        F.col("l_orderkey").alias("annotation_index"), F.col("l_linenumber").alias("start_us")
    )
    return I.annotation_stats(ann.join(ranges, "annotation_index", "left"))


@query(
    "e7_label_summary",
    sql("SELECT split, class_id, count(*) AS windows FROM chrono JOIN wcls USING (run, w) GROUP BY ALL", "wins", "wcls", **_CHRONO),
)
def _(t: Tables):
    classed = Wn.window_class(windows_of(t), labelled_of(t), SPEC)
    return I.label_summary(Sp.split_chrono(classed))


@query(
    "e8_seed_summary",
    f"""SELECT l_returnflag AS metric, {r("avg(v)", "mean")}, {r("coalesce(stddev_samp(v), 0)", "std")}, count(*) AS runs FROM
    (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) FILTER (l_quantity > 10) AS v FROM lineitem GROUP BY ALL) WHERE v IS NOT NULL GROUP BY ALL""",
)
def _(t: Tables):
    per = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(
        F.avg(F.when(F.col("l_quantity") > 10, F.col("l_extendedprice"))).alias("value")
    )
    out = I.seed_summary(per.withColumnRenamed("l_returnflag", "metric"), ["metric"])
    return out.withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query(
    "e9_top_fraction_mean",
    f"""SELECT "group", {r("avg(score) FILTER (rn <= keep)", "top_mean")}, {r("avg(score)", "mean")}, {r("max(score)", "max")}, count(*) AS n FROM
    (SELECT user_id AS "group", value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn,
            greatest(1, ceil(count(*) OVER (PARTITION BY user_id) * 0.1::DOUBLE)) AS keep FROM events) GROUP BY "group" """,
)
def _(t: Tables):
    s = t.events.select(F.col("user_id").alias("group"), F.col("value").alias("score"))
    out = top_mean(s, ["group"], "score", 0.1)
    return out.withColumns({c: rounded(c) for c in ("top_mean", "mean", "max")})


@query(
    "e10_majority_value",
    """SELECT run, arg_min(v, (-n, v)) AS majority, max(n) AS majority_count, count(*) AS distinct_values, sum(n)::BIGINT AS rows FROM
    (SELECT o_custkey AS run, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL) GROUP BY run""",
)
def _(t: Tables):
    return I.majority_value(t.orders.withColumnRenamed("o_custkey", "run"), "o_orderpriority", ["run"])


@query(
    "e12_effect_checks",
    f"""SELECT part, {r("bf", "baseline_fraction")}, {r("bm", "baseline_mean")}, {r("bs", "baseline_std")}, {r("ff", "fault_fraction")},
    {r("fm", "fault_mean")}, {r("fs", "fault_std")}, first_hit, bf < 0.1 AND ff > 0.9 AS fraction_effect,
    abs(bm) < 0.1 AND abs(fm) > 15 AS mean_effect, bs > 0.1 AND fs < 0.25 * bs AS std_effect FROM
    (SELECT l_partkey AS part, avg(hit) FILTER (c = 'baseline') AS bf, avg(v) FILTER (c = 'baseline') AS bm, stddev_pop(v) FILTER (c = 'baseline') AS bs,
     avg(hit) FILTER (c = 'fault') AS ff, avg(v) FILTER (c = 'fault') AS fm, stddev_pop(v) FILTER (c = 'fault') AS fs,
     min(t) FILTER (c = 'fault' AND hit = 1) AS first_hit FROM
     (SELECT l_partkey, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'before' WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'fault' END AS c, (l_quantity > 20)::INT::DOUBLE AS hit,
      l_quantity - 20 AS v, epoch_us(l_shipdate) AS t FROM lineitem) GROUP BY 1)
    ORDER BY part""".replace("(SELECT l_partkey AS part,", "(SELECT l_partkey AS part,", 1),
)
def _(t: Tables):
    li = t.lineitem.select(
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_linestatus") == "O", "baseline").otherwise("fault").alias("condition"),
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).alias("post"),
        (F.col("l_quantity") > 20).alias("hit"),
        (F.col("l_quantity") - 20).alias("value"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"),
    )
    out = I.effect_checks(li, ["part"])
    names = [f"{c}_{s}" for c in ("baseline", "fault") for s in ("fraction", "mean", "std")]
    return out.withColumns({n: rounded(n) for n in names})


@query(
    "e13_norm_validity",
    f"""SELECT label, count(*) AS vectors, {r("avg((n > 0.995 AND n < 1.005)::INT)", "valid_fraction")} FROM
    (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM
     (SELECT label::BIGINT AS label, list_concat(embedding, [((vec_id % 10) * 0.02)::FLOAT]) AS embedding FROM embeddings)) GROUP BY label""",
)
def _(t: Tables):
    shifted = t.embeddings.select(
        F.col("label").cast("long").alias("label"),
        F.concat("embedding", F.array(((F.col("vec_id") % 10) * 0.02).cast("float"))).alias("embedding"),
    )
    return S.norm_validity(shifted, ["label"], "embedding", 0.995, 1.005).withColumn("valid_fraction", rounded("valid_fraction"))


@query(
    "e15_console_metrics",
    f"""SELECT lang, count(*) AS logs, count(pages_seen) AS with_counter, {r("sum(pages_seen)", "total")}, count(*) FILTER (coalesce(n_chars >= d - 1, false)) AS complete FROM
    (SELECT lang, n_chars, try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE) AS pages_seen, length(text) AS d FROM documents) GROUP BY lang""",
)
def _(t: Tables):
    logs = t.documents.withColumn("duration_s", F.length("text")).withColumn("last_s", F.col("n_chars"))
    out = I.console_metrics(logs, {"pages_seen": "([0-9]+)"})
    return out.groupBy("lang").agg(
        F.count(F.lit(1)).alias("logs"),
        F.count("pages_seen").alias("with_counter"),
        rounded(F.sum("pages_seen")).alias("total"),
        F.count(F.when(F.col("coverage_ok"), 1)).alias("complete"),
    )


@query(
    "e16_score_audit",
    f"""SELECT s.run, s.windows, {r("min_score", "min_score")}, {r("max_score", "max_score")}, {r("median_score", "median_score")}, {r("z", "zero_fraction")}, true AS all_finite
    FROM (SELECT l_suppkey AS run, count(*) AS windows, min(l_discount) AS min_score, max(l_discount) AS max_score, quantile_cont(l_discount, 0.5) AS median_score
          FROM lineitem GROUP BY 1) s JOIN (SELECT l_suppkey AS run, avg((l_tax = 0)::INT) AS z FROM lineitem GROUP BY 1) f USING (run)""",
)
def _(t: Tables):
    s = t.lineitem.select(F.col("l_suppkey").alias("run"), F.col("l_discount").alias("score"))
    f = t.lineitem.select(F.col("l_suppkey").alias("run"), F.col("l_tax").alias("value"))
    out = I.score_audit(s, f)
    return out.withColumns({c: rounded(c) for c in ("min_score", "max_score", "median_score", "zero_fraction")})


@query(
    "e17_leakage_audit",
    sql(
        """SELECT a.split || '/' || b.split AS pair, count(*) AS shared_groups FROM (SELECT DISTINCT run, split FROM chrono) a
        JOIN (SELECT DISTINCT run, split FROM chrono) b ON a.run = b.run AND a.split < b.split GROUP BY ALL""",
        "wins", **_CHRONO,
    ),
)
def _(t: Tables):
    return I.leakage_audit(Sp.split_chrono(windows_of(t)))


@query(
    "e18_feature_parity",
    sql(
        f"""SELECT channel, {r("max(abs(a.mean - b.mean))", "max_error")}, count(*) FILTER (a.run IS NULL OR b.run IS NULL) AS unmatched, count(*) AS rows
        FROM (SELECT run, channel, w, avg(x) AS mean FROM wx GROUP BY ALL) a FULL JOIN
        (SELECT run, channel, w, avg(x) AS mean FROM raw JOIN wins USING (run) WHERE k BETWEEN start_k AND start_k + {W - 1} GROUP BY ALL) b USING (run, channel, w) GROUP BY channel""",
        "wx",
        raw="SELECT run, channel, k, round(value, 2) AS x FROM filled",
    ),
)
def _(t: Tables):
    mean = F.col("d")[0].alias("value")
    a = described_of(t).select("run", "channel", "w", mean)
    rough = filled_of(t).withColumn("value", F.round("value", 2))
    b = Wn.descriptors(rough, SPEC).select("run", "channel", "w", mean)
    return I.parity(a, b, ["run", "channel", "w"], by=["channel"]).withColumn("max_error", rounded("max_error"))


@query(
    "e19_gain_share",
    f"""SELECT channel, {r("gain", "gain")}, {r("gain / sum(gain) OVER ()", "share")} FROM
    (SELECT p_type AS channel, sum(l_extendedprice * l_discount) AS gain FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""".replace(
        r("gain", "gain"), "round(gain, 2) + 0.0 AS gain"
    ),
)
def _(t: Tables):
    imp = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("channel"), (F.col("l_extendedprice") * F.col("l_discount")).alias("gain")
    )
    return I.gain_share(imp).withColumns({"gain": rounded("gain", 2), "share": rounded("share")})


_AVAIL = {
    **_SUPPORT_SQL,
    "valid": f"SELECT w.run, c.channel, w.w, count(*) FILTER (s.valid) = {W} AS ok FROM wins w JOIN chan c ON true"
    f" LEFT JOIN sup s ON s.run = w.run AND s.channel = c.channel AND s.k BETWEEN w.start_k AND w.start_k + {W - 1} GROUP BY ALL",
}


@query(
    "e20_availability",
    sql(
        f"""SELECT channel, {r("avg(a)", "mean")}, count(*) AS n, {r("quantile_cont(a, 0.5)", "median")} FROM
        (SELECT run, channel, avg(ok::INT) AS a FROM valid GROUP BY ALL) GROUP BY channel""",
        "around", "lin", "wins", "chan", **_AVAIL,
    ),
)
def _(t: Tables):
    wins = windows_of(t).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    valid = Wn.window_validity(wins, supported_of(t), SPEC)
    out = I.availability_summary(I.availability(valid), ["channel"])
    return out.withColumns({"mean": rounded("mean"), "median": rounded("median")})


__all__ = ["described_of", "scaler_of", "status_of", "_CHRONO", "_STATUS_SQL"]
