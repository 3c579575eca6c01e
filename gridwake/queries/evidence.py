"""Attribution evidence over the embedding contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.catalogue import CHANNELS, EXCLUSION_RULES, PAIR_RULES, TOKEN_RULES
from gridwake.functions.numeric import rounded
from gridwake.functions.text import first_token, module_of
from gridwake.operators import evidence as V
from gridwake.queries.calibration import scaled_of
from gridwake.queries.registry import Tables, query
from gridwake.queries.sqlkit import r, sql

EV = {
    "co": "SELECT vec_id AS row, label % 4 + 1 AS true_class, vec_id % 4 + 1 AS predicted_class, vec_id % 5 AS seed, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "dm": "SELECT *, feature // 4 AS channel, feature // 16 AS topic, 's' || (feature // 32) AS subsystem FROM co",
    "lv": "SELECT row, true_class, seed, level, name, sum(abs(value)) AS value FROM (SELECT *, 'feature' AS level, feature::VARCHAR AS name FROM dm UNION ALL SELECT *, 'channel', channel::VARCHAR FROM dm"
    " UNION ALL SELECT *, 'topic', topic::VARCHAR FROM dm UNION ALL SELECT *, 'subsystem', subsystem FROM dm) GROUP BY ALL",
    "ch": "SELECT row, true_class, seed, channel, channel % 4 + 1 AS channel_class, sum(abs(value)) AS value FROM dm GROUP BY ALL",
}


def contributions_of(t: Tables):
    e = t.embeddings.select(
        F.col("vec_id").alias("row"), (F.col("label") % 4 + 1).cast("long").alias("true_class"), (F.col("vec_id") % 4 + 1).alias("predicted_class"),
        (F.col("vec_id") % 5).alias("seed"), F.posexplode("embedding").alias("feature", "value"),
    )
    f = F.col("feature").cast("long")
    return e.select(
        "row", "true_class", "predicted_class", "seed", f.alias("feature"), F.col("value").cast("double").alias("value"),
        F.floor(f / 4).cast("long").alias("channel"), F.floor(f / 16).cast("long").alias("topic"), F.concat(F.lit("s"), F.floor(f / 32)).alias("subsystem"),
    )


def levels_of(t: Tables):
    return V.rollup(contributions_of(t), ["row", "true_class", "seed"])


def channels_of(t: Tables):
    c = contributions_of(t).groupBy("row", "true_class", "seed", "channel").agg(F.sum(F.abs("value")).alias("value"))
    return c.withColumn("channel_class", F.col("channel") % 4 + 1)


@query(
    "i1_predicted_contrib",
    sql(f"SELECT row, predicted_class AS class_id, feature AS term, {r('value * predicted_class', 'value')} FROM (SELECT row, predicted_class, 'f' || feature AS feature, value FROM co)", co=EV["co"]),
)
def _(t: Tables):
    base = contributions_of(t)
    classes = F.explode(F.array(*[F.lit(c).cast("long") for c in (1, 2, 3, 4)]))
    terms = base.select("row", F.concat(F.lit("f"), F.col("feature")).alias("term"), "value")
    bias = t.embeddings.select(F.col("vec_id").alias("row"), F.lit("bias").alias("term"), F.lit(1.0).alias("value"))
    contrib = terms.unionByName(bias).withColumn("class_id", classes).withColumn("value", F.col("value") * F.col("class_id"))
    preds = t.embeddings.select(F.col("vec_id").alias("row"), (F.col("vec_id") % 4 + 1).alias("predicted_class"))
    return V.predicted_contrib(contrib, preds).select("row", "class_id", "term", rounded("value").alias("value"))


@query("i2_rollup", sql(f"SELECT row, level, name, {r('value', 'value')} FROM lv", **EV))
def _(t: Tables):
    return levels_of(t).select("row", "level", "name", rounded("value").alias("value"))


@query("i3_conservation", sql("SELECT level, true AS conserved FROM lv GROUP BY level", **EV))
def _(t: Tables):
    return V.conservation(levels_of(t), ["row"]).select("level", (F.col("max_error") <= 1e-9).alias("conserved"))


_IMP = {
    "sp": "SELECT 'all' AS scope, * FROM lv UNION ALL SELECT true_class::VARCHAR, * FROM lv",
    "im": "SELECT scope, level, name, avg(value) AS mean_abs, count(*) AS rows FROM sp GROUP BY ALL",
}


@query("i4_importance", sql(f"SELECT scope, level, name, {r('mean_abs', 'mean_abs')}, rows, row_number() OVER (PARTITION BY scope, level ORDER BY mean_abs DESC, name) AS rank FROM im", **EV, **_IMP))
def _(t: Tables):
    return V.importance(levels_of(t)).withColumn("mean_abs", rounded("mean_abs"))


@query(
    "i5_importance_summary",
    sql(
        f"""SELECT scope, level, name, {r("m", "mean")}, {r("s", "std")}, seeds, fc AS feature_count, {r("m / fc", "per_feature")}, {r("m / sum(m) OVER (PARTITION BY scope, level)", "share")},
        row_number() OVER (PARTITION BY scope, level ORDER BY m DESC, name) AS rank FROM (SELECT scope, level, name, avg(a) AS m, stddev_samp(a) AS s, count(DISTINCT seed) AS seeds FROM
        (SELECT seed, scope, level, name, avg(value) AS a FROM sp GROUP BY ALL) GROUP BY ALL)
        JOIN (SELECT level, name, count(DISTINCT feature) AS fc FROM (SELECT feature, 'feature' AS level, feature::VARCHAR AS name FROM dm UNION SELECT feature, 'channel', channel::VARCHAR FROM dm
          UNION SELECT feature, 'topic', topic::VARCHAR FROM dm UNION SELECT feature, 'subsystem', subsystem FROM dm) GROUP BY ALL) USING (level, name)""",
        **EV, sp=_IMP["sp"],
    ),
)
def _(t: Tables):
    per = V.importance(levels_of(t), by=["seed"])
    dims = contributions_of(t).select("feature", "channel", "topic", "subsystem").distinct().withColumn("value", F.lit(1.0))
    counts = V.rollup(dims, []).select("level", "name", F.col("value").cast("long").alias("feature_count"))
    out = V.summarize_importance(per, counts)
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "per_feature", "share")})


@query(
    "i6_consistency_at_k",
    sql(
        f"""SELECT seed, count(*) AS windows, {r("avg(m / 3)", "consistency")}, {r("avg((m > 0)::INT)", "hit_rate")}, {r("avg(CASE WHEN a > 0 THEN mass / a ELSE 0 END)", "weighted_consistency")} FROM
        (SELECT seed, row, count(*) FILTER (rn <= 3 AND ok) AS m, coalesce(sum(value) FILTER (ok), 0) AS mass, sum(value) AS a FROM
         (SELECT *, channel_class = true_class AS ok, row_number() OVER (PARTITION BY row ORDER BY value DESC, channel) AS rn FROM ch) GROUP BY ALL) GROUP BY seed""",
        **EV,
    ),
)
def _(t: Tables):
    out = V.consistency_at_k(channels_of(t), 3, ["seed"])
    return out.withColumns({c: rounded(c) for c in ("consistency", "hit_rate", "weighted_consistency")})


@query(
    "i7_random_consistency",
    sql(
        f"""SELECT {r("avg(m / n)", "consistency")}, {r("avg(1 - (n - m) * (n - m - 1.0) * (n - m - 2.0) / (n * (n - 1.0) * (n - 2.0)))", "hit_rate")} FROM
        (SELECT row, (SELECT count(DISTINCT channel) FROM ch) AS n, (SELECT count(DISTINCT channel) FROM ch c WHERE c.channel_class = t.true_class) AS m FROM (SELECT DISTINCT row, true_class FROM ch) t)""",
        **EV,
    ),
)
def _(t: Tables):
    ch = channels_of(t)
    rows = t.embeddings.select((F.col("label") % 4 + 1).cast("long").alias("true_class"))
    out = V.random_consistency(rows, ch.select("channel", "channel_class").distinct(), 3)
    return out.withColumns({"consistency": rounded("consistency"), "hit_rate": rounded("hit_rate")})


@query(
    "i8_evidence_rows",
    sql(
        f"""SELECT row, channel, channel_class, {r("value", "value")}, rank, label FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY value DESC, channel) AS rank FROM ch)
        JOIN (SELECT vec_id AS row, label::BIGINT AS label FROM embeddings) USING (row) WHERE rank <= 5""",
        **EV,
    ),
)
def _(t: Tables):
    meta = t.embeddings.select(F.col("vec_id").alias("row"), F.col("label").cast("long").alias("label"))
    return V.evidence_rows(channels_of(t), meta, 5).select("row", "channel", "channel_class", rounded("value").alias("value"), "rank", "label")


_MASK = {
    "rk": "SELECT feature, row_number() OVER (ORDER BY avg(abs(value)) DESC, feature) AS rank FROM co GROUP BY feature",
    "pl": "SELECT 'top' AS variant, k, 0 AS repeat, feature FROM rk, (VALUES (5), (20)) AS v(k) WHERE rank <= k UNION ALL SELECT 'random', k, repeat, feature FROM"
    " (SELECT feature, repeat, row_number() OVER (PARTITION BY repeat ORDER BY sha256('9:' || repeat || ':' || feature)) AS rn FROM rk, (VALUES (1), (2), (3)) AS x(repeat)), (VALUES (5), (20)) AS v(k) WHERE rn <= k",
    "rf": "SELECT feature, quantile_cont(value, 0.5) AS ref FROM co GROUP BY feature",
    "fx": "SELECT p.variant, p.k, p.repeat, c.row, c.true_class, sum(CASE WHEN m.feature IS NOT NULL THEN rf.ref ELSE c.value END * ((c.feature % 7) - 3)) AS s FROM co c"
    " JOIN (SELECT DISTINCT variant, k, repeat FROM pl) p ON true LEFT JOIN pl m ON m.variant = p.variant AND m.k = p.k AND m.repeat = p.repeat AND m.feature = c.feature JOIN rf ON rf.feature = c.feature GROUP BY ALL",
    "b0": "SELECT row, true_class, sum(value * ((feature % 7) - 3)) AS s FROM co GROUP BY ALL",
}


@query(
    "i9_masking",
    sql(
        f"""SELECT variant, k, {r("(SELECT avg(((s > 0) = (true_class <= 2))::INT) FROM b0) - avg(a)", "drop")}, count(*) AS repeats FROM
        (SELECT variant, k, repeat, avg(((s > 0) = (true_class <= 2))::INT) AS a FROM fx GROUP BY ALL) GROUP BY variant, k""",
        co=EV["co"], **_MASK,
    ),
)
def _(t: Tables):
    from pyspark.sql import Window

    from gridwake.operators.splits import reference_vector

    c = contributions_of(t).select("row", "true_class", "feature", "value")
    rank = c.groupBy("feature").agg(F.avg(F.abs("value")).alias("m"))
    rank = rank.withColumn("rank", F.row_number().over(Window.orderBy(F.col("m").desc(), "feature"))).select("feature", "rank")
    plan = V.masking_plan(rank, (5, 20), 3, 9)
    ref = reference_vector(c, ["feature"])
    weight = F.col("feature") % 7 - 3
    right = F.avg((((F.col("s") > 0) == (F.col("true_class") <= 2)).cast("double")))
    sets = plan.select("variant", "k", "repeat").distinct().select(F.collect_list(F.struct("variant", "k", "repeat")).alias("s")).scalar()
    spread = c.withColumn("p", F.explode(sets)).select("row", "true_class", "feature", "value", "p.*")
    masked = V.mask_features(spread, plan, ref, ["variant", "k", "repeat", "feature"])
    scored = masked.groupBy("variant", "k", "repeat", "row", "true_class").agg(F.sum(F.col("value") * weight).alias("s"))
    acc = scored.groupBy("variant", "k", "repeat").agg(right.alias("accuracy"))
    base = c.groupBy("row", "true_class").agg(F.sum(F.col("value") * weight).alias("s")).agg(right).scalar()
    return V.masking_drop(base, acc, metric="accuracy").withColumns({"drop": rounded("drop"), "k": F.col("k").cast("int")})


@query(
    "i10_linear_contributions",
    sql(f"SELECT row, feature, {r('((feature % 7) - 3) * 0.5 * (value - avg(value) OVER (PARTITION BY feature))', 'contribution')} FROM co", co=EV["co"]),
)
def _(t: Tables):
    c = contributions_of(t).select("row", "feature", "value")
    stats = c.groupBy("feature").agg(F.avg("value").alias("mean"))
    coefs = stats.select("feature", ((F.col("feature") % 7 - 3) * 0.5).alias("coef"))
    return V.linear_contributions(c, coefs, stats).select("row", "feature", rounded("contribution").alias("contribution"))


@query(
    "i11_scoped_importance",
    sql(
        f"""SELECT scope, level, name, {r("mean_abs", "mean_abs")}, rows, row_number() OVER (PARTITION BY scope, level ORDER BY mean_abs DESC, name) AS rank FROM im""",
        co=EV["co"], dm=EV["dm"], lv=EV["lv"].replace("FROM dm", "FROM (SELECT * FROM dm WHERE predicted_class = true_class)"), **_IMP,
    ),
)
def _(t: Tables):
    c = contributions_of(t)
    hits = t.embeddings.filter(F.col("label") % 4 + 1 == F.col("vec_id") % 4 + 1).select(F.col("vec_id").alias("row"))
    return V.scoped_importance(c, hits, ["row", "true_class", "seed"]).withColumn("mean_abs", rounded("mean_abs"))


@query(
    "i12_feature_drivers",
    sql(
        f"""SELECT run, feature, {r("m", "maximum")}, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY m DESC, feature) AS rank FROM (SELECT run, feature, max(s) AS m FROM
        (SELECT *, min(scaled) OVER q AS s, count(*) OVER q AS n FROM sc WINDOW q AS (PARTITION BY run, feature ORDER BY w ROWS 2 PRECEDING)) WHERE n = 3 GROUP BY ALL)) WHERE rank <= 5""",
        "sc",
    ),
)
def _(t: Tables):
    return V.feature_drivers(scaled_of(t), 3).select("run", "feature", rounded("maximum").alias("maximum"), "rank")


def _case_tokens(col: str, rules, default: str | None) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({col}), '{tok}')" for tok in toks) + f" THEN '{lab}'" for lab, toks in rules)
    return f"CASE {arms} ELSE {'NULL' if default is None else repr(default)} END"


_CHLIST = "[" + ", ".join(f"'{c}'" for c in CHANNELS) + "]"
_NCH = len(CHANNELS)


def _channel_rows(t: Tables):
    names = F.array(*[F.lit(c) for c in CHANNELS])
    return t.lineitem.select(F.element_at(names, (F.col("l_partkey") % _NCH + 1).cast("int")).alias("channel"), "l_quantity")


@query(
    "b7_token_classifier",
    f"""SELECT channel, {_case_tokens("channel", TOKEN_RULES, "Shared")} AS subsystem, count(*) AS rows FROM (SELECT {_CHLIST}[l_partkey % {_NCH} + 1] AS channel FROM lineitem) GROUP BY ALL""",
)
def _(t: Tables):
    return _channel_rows(t).groupBy("channel").agg(F.count(F.lit(1)).alias("rows")).withColumn("subsystem", first_token("channel", TOKEN_RULES, "Shared"))


_PAIR_CASE = (
    "CASE WHEN topic = 'vehicle_vision_position' THEN 'External Position' "
    + " ".join(f"WHEN channel IN ({', '.join(repr(n) for n in names)}) THEN '{lab}'" for lab, names in PAIR_RULES["pairs"].items())
    + " " + " ".join(f"WHEN topic = '{k}' THEN '{v}'" for k, v in PAIR_RULES["topics"].items())
    + " WHEN topic = 'estimator_status' AND starts_with(field, 'vibe[') THEN 'Mechanical/Electrical' ELSE 'Shared' END"
)


@query(
    "b8_pair_classifier",
    f"""SELECT channel, {_PAIR_CASE} AS subsystem, rows FROM (SELECT channel, split_part(channel, '.', 1) AS topic, substr(channel, strpos(channel, '.') + 1) AS field, count(*) AS rows
    FROM (SELECT {_CHLIST}[l_partkey % {_NCH} + 1] AS channel FROM lineitem) GROUP BY ALL)""",
)
def _(t: Tables):
    return _channel_rows(t).groupBy("channel").agg(F.count(F.lit(1)).alias("rows")).withColumn("subsystem", V.classify_pairs("channel", PAIR_RULES))


_DIRS = (
    "src/modules/nav/", "src/Examples/demo/", "src/lib/ekf/", "boards/Bebop/cfg/", "platforms/posix/src/", "src\\templates\\x\\", "src/drivers/test/unit/",
    "platforms/qurt/fw/", "msg/", "src/modules/replay/", "a/linux_io/", "src/systemcmds/hwtest/", "",
)
_DIRLIST = "[" + ", ".join(f"'{d}'" for d in _DIRS) + "]"
_PATH = f"{_DIRLIST}[p_partkey % {len(_DIRS)} + 1] || replace(p_name, ' ', '/')"


def _paths(t: Tables):
    dirs = F.array(*[F.lit(d) for d in _DIRS])
    path = F.concat(F.element_at(dirs, (F.col("p_partkey") % len(_DIRS) + 1).cast("int")), F.replace("p_name", F.lit(" "), F.lit("/")))
    return t.part.select("p_partkey", path.alias("path"))


@query(
    "b9_exclusion_reason",
    f"""SELECT p_partkey, path, {_case_tokens("'/' || replace(path, chr(92), '/')", EXCLUSION_RULES, None)} AS reason FROM (SELECT p_partkey, {_PATH} AS path FROM part)""",
)
def _(t: Tables):
    slashed = F.concat(F.lit("/"), F.replace("path", F.lit("\\"), F.lit("/")))
    return _paths(t).withColumn("reason", first_token(slashed, EXCLUSION_RULES, None))


@query(
    "b10_module_of",
    f"""SELECT p_partkey, path, CASE WHEN len(s) >= 3 AND s[1] = 'src' AND s[2] IN ('modules', 'drivers', 'examples', 'systemcmds', 'lib') THEN array_to_string(s[1:3], '/')
    WHEN len(s) = 1 THEN '.' ELSE array_to_string(s[1:-2], '/') END AS module FROM (SELECT p_partkey, path, string_split(path, '/') AS s FROM (SELECT p_partkey, {_PATH} AS path FROM part))""",
)
def _(t: Tables):
    return _paths(t).withColumn("module", module_of("path"))
