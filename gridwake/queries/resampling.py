"""Cluster bootstraps and exact tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.functions.numeric import ratio, rounded
from gridwake.operators import bootstrap as B
from gridwake.queries.metrics import CLASSES, SC, line_scores_of, preds_of
from gridwake.queries.registry import Tables, query
from gridwake.queries.sqlkit import r, sql

REPS, SEED = 1000, 17


def weights_cte(source: str, group: str = '"group"', seed: str = str(SEED), tag: str = "") -> dict[str, str]:
    # shared expressions are materialised by `sql`, so the draws are made once
    return {
        f"gi{tag}": f"SELECT g, row_number() OVER (ORDER BY md5(g::VARCHAR), g) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {group} AS g FROM {source})",
        f"dr{tag}": f"SELECT rep, concat('0x', substr(md5('{seed}:' || rep || ':' || idx), 1, 8))::BIGINT % n AS pos, count(*) AS weight FROM gi{tag}, range({REPS}) AS x(rep) GROUP BY ALL",
        f"bw{tag}": f"SELECT rep, g, weight FROM dr{tag} JOIN gi{tag} ON idx = pos",
    }


CI = f"{r('avg(v)', 'bootstrap_mean')}, {r('quantile_cont(v, 0.025)', 'ci_low')}, {r('quantile_cont(v, 0.975)', 'ci_high')}, count(v) AS replicates"
CI_COLS = ("bootstrap_mean", "ci_low", "ci_high")


def tidy(df):
    return df.withColumns({c: rounded(c) for c in CI_COLS})


@query("l1_bootstrap_weights", sql('SELECT rep, g AS "group", weight FROM bw', ls=SC["ls"], **weights_cte("ls")))
def _(t: Tables):
    return B.bootstrap_weights(line_scores_of(t), REPS, SEED)


@query(
    "l2_grouped_bootstrap",
    sql(
        f"""SELECT {CI}, (SELECT count(DISTINCT g) FROM bw) AS units FROM (SELECT rep, sum(weight * s) / sum(weight * n) AS v FROM bw JOIN
        (SELECT "group" AS g, sum(score) AS s, count(*) AS n FROM ls GROUP BY 1) USING (g) GROUP BY rep)""",
        ls=SC["ls"], **weights_cte("ls"),
    ),
)
def _(t: Tables):
    s = line_scores_of(t)
    stats = s.groupBy("group").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    w = B.bootstrap_weights(s, REPS, SEED)

    def mean(df):
        return df.groupBy("rep").agg(ratio(F.sum(F.col("weight") * F.col("s")), F.sum(F.col("weight") * F.col("n"))).alias("mean"))

    return tidy(B.grouped_bootstrap(stats, w, mean, "mean"))


def f1_cte(source: str, keys: str) -> dict[str, str]:
    lab = ", ".join(f"({c})" for c in CLASSES)
    return {
        "wc": f"SELECT {keys}, true_class, predicted_class, sum(weight * n) AS n FROM (SELECT {source}.*, g FROM {source}) JOIN bw USING (g) GROUP BY ALL",
        "pcl": f"SELECT {keys}, c, coalesce(sum(n) FILTER (true_class = c AND predicted_class = c), 0) AS tp, coalesce(sum(n) FILTER (true_class = c), 0) AS st,"
        f" coalesce(sum(n) FILTER (predicted_class = c), 0) AS pp FROM wc, (VALUES {lab}) AS v(c) GROUP BY ALL",
        "f1": f"SELECT {keys}, avg(coalesce(2.0 * tp / nullif(st + pp, 0), 0)) AS v FROM pcl GROUP BY ALL",
    }


_CONF = 'SELECT "group" AS g, method, true_class, predicted_class, count(*) AS n FROM pr GROUP BY ALL'


@query("l3_macro_f1_bootstrap", sql(f"SELECT method, {CI} FROM f1 GROUP BY method", pr=SC["pr"], **weights_cte("pr"), cf=_CONF, **f1_cte("cf", "method, rep")))
def _(t: Tables):
    p = preds_of(t)
    reps = B.macro_f1_replicates(p, B.bootstrap_weights(p, REPS, SEED), CLASSES, ["method"])
    return tidy(B.interval(reps, "macro_f1", ["method"]))


def ap_cte(source: str, keys: str) -> dict[str, str]:
    return {
        "wa": f'SELECT {keys}, score, sum(weight * label) AS pos, sum(weight) AS n FROM {source} s JOIN bw ON bw.g = s."group" GROUP BY ALL',
        "wb": f"SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS seen, sum(pos) OVER (PARTITION BY {keys}) AS p FROM wa",
        "ap": f"SELECT {keys}, sum(pos * tp / seen) / nullif(max(p), 0) AS v FROM wb GROUP BY ALL",
    }


@query("l4_ap_bootstrap", sql(f"SELECT {CI} FROM ap", ls=SC["ls"], **weights_cte("ls"), **ap_cte("ls", "rep")))
def _(t: Tables):
    s = line_scores_of(t)
    return tidy(B.interval(B.ap_replicates(s, B.bootstrap_weights(s, REPS, SEED)), "auprc"))


@query(
    "l5_paired_ci",
    sql(f"SELECT {CI} FROM (SELECT rep, max(v) FILTER (method = 'R') - max(v) FILTER (method = 'A') AS v FROM f1 GROUP BY rep)", pr=SC["pr"], **weights_cte("pr"), cf=_CONF, **f1_cte("cf", "method, rep")),
)
def _(t: Tables):
    p = preds_of(t)
    reps = B.macro_f1_replicates(p, B.bootstrap_weights(p, REPS, SEED), CLASSES, ["method"])
    return tidy(B.interval(B.paired_difference(reps, "method", "R", "A", "macro_f1"), "difference"))


_SEEDED = 'SELECT l_suppkey AS "group", l_linenumber AS seed, l_discount AS score, (l_returnflag = \'R\')::BIGINT AS label FROM lineitem'


@query("l6_pooled_ci", sql(f"SELECT {CI} FROM (SELECT rep, avg(v) AS v FROM ap GROUP BY rep)", ls=_SEEDED, **weights_cte("ls"), **ap_cte("ls", "seed, rep")))
def _(t: Tables):
    s = t.lineitem.select(
        F.col("l_suppkey").alias("group"), F.col("l_linenumber").alias("seed"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("long").alias("label")
    )
    s = B.require_same_groups(s)
    reps = B.ap_replicates(s, B.bootstrap_weights(s, REPS, SEED), ["seed"])
    return tidy(B.interval(B.pooled_replicates(reps, "auprc"), "auprc"))


_CELL = "SELECT l_suppkey AS log, l_linenumber AS mutation, avg(l_discount) AS v FROM lineitem GROUP BY ALL"


def cells_of(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("log"), F.col("l_linenumber").alias("mutation")).agg(F.avg("l_discount").alias("v"))


@query(
    "l7_two_way_bootstrap",
    sql(f"SELECT {CI} FROM (SELECT a.rep, sum(c.v * a.weight * b.weight) / sum(a.weight * b.weight) AS v FROM ce c JOIN bwr a ON a.g = c.log JOIN bwc b ON b.g = c.mutation AND b.rep = a.rep GROUP BY a.rep)",
        ce=_CELL, **weights_cte("ce", "log", f"{SEED}r", "r"), **weights_cte("ce", "mutation", f"{SEED}c", "c")),
)
def _(t: Tables):
    return tidy(B.interval(B.two_way_replicates(cells_of(t), REPS, SEED, "log", "mutation", "v"), "estimate"))


@query(
    "k11_pivot_complete",
    f"""SELECT log, {', '.join(r(f'max(v) FILTER (mutation = {i})', f'"{i}"') for i in range(1, 8))} FROM ({_CELL}) GROUP BY log""",
)
def _(t: Tables):
    cols = list(range(1, 8))
    wide = B.pivot_complete(cells_of(t), "log", "mutation", cols, "v")
    return wide.select("log", *[rounded(F.col(f"`{c}`")).alias(str(c)) for c in cols])


@query(
    "l8_masking_ci",
    sql(f"SELECT {CI} FROM (SELECT rep, (max(v) FILTER (method = 'A') + max(v) FILTER (method = 'N')) / 2 - max(v) FILTER (method = 'R') AS v FROM f1 GROUP BY rep)",
        pr=SC["pr"], **weights_cte("pr"), cf=_CONF, **f1_cte("cf", "method, rep")),
)
def _(t: Tables):
    """Methods A and N as two random repeats, R as the targeted mask."""
    p = preds_of(t)
    reps = B.macro_f1_replicates(p, B.bootstrap_weights(p, REPS, SEED), CLASSES, ["method"])
    kind = F.when(F.col("method") == "R", "targeted").otherwise("random")
    pooled = B.pooled_replicates(reps.withColumn("kind", kind), "macro_f1", ["rep", "kind"])
    return tidy(B.interval(B.paired_difference(pooled, "kind", "random", "targeted", "macro_f1"), "difference"))


@query(
    "l9_sign_flip",
    f"""WITH d AS (SELECT l_suppkey % 10 AS c, avg(l_discount) FILTER (l_returnflag = 'R') - avg(l_discount) FILTER (l_returnflag = 'A') AS x FROM lineitem GROUP BY 1),
    f AS (SELECT p, abs(sum(CASE WHEN (p >> i) & 1 = 1 THEN -x ELSE x END)) AS s FROM range(1024) AS q(p), (SELECT x, row_number() OVER (ORDER BY x)::INT - 1 AS i FROM d) GROUP BY p)
    SELECT 10::BIGINT AS clusters, {r("(SELECT abs(sum(x)) / 10 FROM d)", "mean_abs")}, {r("avg((s >= (SELECT abs(sum(x)) FROM d) - 1e-12)::INT)", "p_value")} FROM f""",
)
def _(t: Tables):
    flag = F.col("l_returnflag")
    d = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("c")).agg(
        (F.avg(F.when(flag == "R", F.col("l_discount"))) - F.avg(F.when(flag == "A", F.col("l_discount")))).alias("difference")
    )
    return B.sign_flip_p(d).withColumns({"mean_abs": rounded("mean_abs"), "p_value": rounded("p_value")})

