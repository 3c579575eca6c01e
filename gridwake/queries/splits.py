"""Splits, samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.functions.numeric import rounded
from gridwake.operators import labels as L
from gridwake.operators import splits as Sp
from gridwake.operators import windows as Wn
from gridwake.queries.features import _CHRONO, described_of
from gridwake.queries.grid import labelled_of, windows_of
from gridwake.queries.registry import SPEC, Tables, query
from gridwake.queries.sqlkit import r, sql

PURGE = SPEC.purge


@query("f1_split_chrono", sql("SELECT run, w, split FROM chrono", "wins", **_CHRONO))
def _(t: Tables):
    return Sp.split_chrono(windows_of(t)).select("run", "w", "split")


@query(
    "f2_split_purged",
    sql(
        f"SELECT run, w, split FROM chrono WHERE NOT (w BETWEEN te - {PURGE} AND te + {PURGE - 1}) AND NOT (w BETWEEN ve - {PURGE} AND ve + {PURGE - 1})",
        "wins", **_CHRONO,
    ),
)
def _(t: Tables):
    return Sp.split_chrono(windows_of(t), purge=PURGE).select("run", "w", "split")


_LLO = {
    "lab": "SELECT c_custkey AS run, coalesce(arg_min(o_orderpriority, o_orderkey), 'Normal') AS label FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "pos": "SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('7:' || label || ':' || run), run) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM lab",
    "te": "SELECT *, greatest(1, floor(n * 0.7::DOUBLE))::BIGINT AS te FROM pos",
    "ve": "SELECT *, least(n, te + greatest(1, floor(n * 0.15::DOUBLE))::BIGINT) AS ve FROM te",
}


@query("f3_split_whole_runs", sql("SELECT run, label, CASE WHEN p < te THEN 'train' WHEN p < ve THEN 'validation' ELSE 'test' END AS split FROM ve", **_LLO))
def _(t: Tables):
    runs = t.customer.select(F.col("c_custkey").alias("run"))
    iv = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("class"))
    return Sp.split_whole_runs(Sp.first_label(iv, runs), 7)


@query(
    "f4_hash_sample",
    """SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
       ORDER BY sha256('11:' || l_orderkey || '-' || l_linenumber), l_orderkey || '-' || l_linenumber) AS rn FROM lineitem) WHERE rn <= 200""",
)
def _(t: Tables):
    li = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return Sp.hash_sample(li, 200, 11, "key", ["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber")


@query(
    "f5_reference_vector",
    f"""WITH s AS (SELECT * FROM embeddings ORDER BY sha256('3:' || vec_id), vec_id::VARCHAR LIMIT 100),
    e AS (SELECT unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS value FROM s)
    SELECT feature, {r("quantile_cont(value, 0.5)", "median")} FROM e GROUP BY feature""",
)
def _(t: Tables):
    picked = Sp.hash_sample(t.embeddings.withColumn("key", F.col("vec_id").cast("string")), 100, 3, "key")
    long = picked.select(F.posexplode("embedding").alias("feature", "value"))
    long = long.select(F.col("feature").cast("long").alias("feature"), F.col("value").cast("double").alias("value"))
    return Sp.reference_vector(long, ["feature"]).withColumn("median", rounded("median"))


@query(
    "f6_source_folds",
    """SELECT f.fold, count(*) AS runs, sum(s.s_suppkey)::BIGINT AS checksum FROM supplier s JOIN
       (SELECT DISTINCT s_nationkey AS fold FROM supplier) f ON f.fold <> s.s_nationkey GROUP BY f.fold""",
)
def _(t: Tables):
    runs = t.supplier.select(F.col("s_suppkey").alias("run"), F.col("s_nationkey").alias("source"))
    return Sp.fold_totals(runs, ["run"]).withColumnRenamed("run", "checksum")


@query(
    "f7_weak_labels",
    """SELECT run, CASE WHEN bool_or(class = 'Uncategorized') THEN 'unknown' WHEN bool_and(class = 'Normal') THEN 'normal' END AS kind FROM
    (SELECT o_custkey AS run, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'Uncategorized' WHEN o_orderstatus = 'F' OR o_totalprice < 300000 THEN 'Normal' ELSE 'Altitude' END AS class FROM orders) GROUP BY run""",
)
def _(t: Tables):
    cls = (
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "Uncategorized")
        .when((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 300000), "Normal")
        .otherwise("Altitude")
    )
    return Sp.weak_labels(t.orders.select(F.col("o_custkey").alias("run"), cls.alias("class")))


@query(
    "b11_hierarchical_label",
    sql("SELECT run, w, CASE WHEN label = 1 THEN class_id ELSE 0 END AS hier_label FROM wlab JOIN wcls USING (run, w)", "wlab", "wcls"),
)
def _(t: Tables):
    return hier_of(t).select("run", "w", "hier_label")


def hier_of(t: Tables):
    points = labelled_of(t)
    both = Wn.window_class(Wn.window_label(windows_of(t), points, SPEC), points, SPEC)
    return L.hierarchical_label(both)


@query(
    "b12_stage2_subset",
    sql(
        f"SELECT f.run, f.w, f.channel, class_id AS hier_label, {r('f.mean', 'mean')} FROM feat f JOIN wlab USING (run, w) JOIN wcls USING (run, w) WHERE label = 1",
        "feat", "wlab", "wcls",
    ),
)
def _(t: Tables):
    sub = L.stage2_subset(hier_of(t)).select("run", "w", "hier_label")
    f = described_of(t).select("run", "w", "channel", rounded(F.col("d")[0]).alias("mean"))
    return f.join(sub, ["run", "w"])
