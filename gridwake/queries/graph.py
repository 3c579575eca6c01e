"""Propagation, rankings and source-text edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import rounded
from gridwake.operators import inspect as I
from gridwake.operators import propagation as Pr
from gridwake.operators import source_text as Tx
from gridwake.queries.registry import Tables, query
from gridwake.queries.sqlkit import r, sql

GR = {
    "ed": "SELECT topic, role, module FROM (SELECT p_brand AS topic, CASE l_returnflag WHEN 'R' THEN 'publisher' ELSE 'subscriber' END AS role, 'm' || (l_suppkey % 40) AS module, sum(l_quantity) AS q"
    " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) QUALIFY 10 * q * count(*) OVER (PARTITION BY topic, role) >= 13 * sum(q) OVER (PARTITION BY topic, role) AND topic <> 'Brand#7'",
    "im": "SELECT l_linestatus AS scope, p_brand AS topic, sum(l_extendedprice) / 1e6 AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "al_b": "SELECT DISTINCT topic, module, 1.0::DOUBLE / count(*) OVER (PARTITION BY topic) AS weight FROM (SELECT DISTINCT topic, module FROM ed)",
    "al_p": "SELECT DISTINCT topic, module, 1.0::DOUBLE / count(*) OVER (PARTITION BY topic) AS weight FROM (SELECT DISTINCT topic, module FROM ed WHERE role = 'publisher')",
    "al_c": "SELECT DISTINCT topic, module, 1.0::DOUBLE / count(*) OVER (PARTITION BY topic) AS weight FROM (SELECT DISTINCT topic, module FROM ed WHERE role = 'subscriber')",
    "ms": "SELECT * REPLACE (round(score, 9) AS score) FROM (SELECT scope, 'bidirectional' AS mode, module, sum(value * weight) AS score FROM im JOIN al_b USING (topic) GROUP BY ALL UNION ALL"
    " SELECT scope, 'producer_only', module, sum(value * weight) FROM im JOIN al_p USING (topic) GROUP BY ALL UNION ALL"
    " SELECT scope, 'consumer_only', module, sum(value * weight) FROM im JOIN al_c USING (topic) GROUP BY ALL UNION ALL SELECT scope, 'topic_only', topic, value FROM im)",
    "rk": "SELECT *, score / sum(score) OVER (PARTITION BY scope, mode) AS share, dense_rank() OVER (PARTITION BY scope, mode ORDER BY score DESC) AS rank FROM ms",
}
MODES = ("bidirectional", "producer_only", "consumer_only", "topic_only")


def edges_of(t: Tables):
    """A module is an edge of a brand if it moves at least 1.3 times the brand's mean quantity; one brand is left unmapped."""
    li = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    role = F.when(F.col("l_returnflag") == "R", "publisher").otherwise("subscriber")
    moved = li.groupBy(F.col("p_brand").alias("topic"), role.alias("role"), F.concat(F.lit("m"), F.col("l_suppkey") % 40).alias("module")).agg(F.sum("l_quantity").alias("q"))
    peers = Window.partitionBy("topic", "role")
    strong = 10 * F.col("q") * F.count(F.lit(1)).over(peers) >= 13 * F.sum("q").over(peers)
    return moved.withColumn("_s", strong).filter("_s AND topic <> 'Brand#7'").select("topic", "role", "module")


def importance_of(t: Tables):
    li = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return li.groupBy(F.col("l_linestatus").alias("scope"), F.col("p_brand").alias("topic")).agg((F.sum("l_extendedprice") / 1e6).alias("value"))


def rankings_of(t: Tables):
    imp, edges = importance_of(t), edges_of(t)
    parts = [Pr.propagate(imp, edges, m) for m in MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("c15_propagate", sql(f"SELECT scope, mode, module, {r('score', 'score')}, {r('share', 'share')}, rank FROM rk", **GR))
def _(t: Tables):
    return rankings_of(t).withColumns({"score": rounded("score"), "share": rounded("share")})


@query(
    "c15_random_mapping",
    sql(
        """SELECT * FROM (WITH mo AS (SELECT module, row_number() OVER (ORDER BY module) - 1 AS i FROM (SELECT DISTINCT module FROM ed)), c AS (SELECT count(*) AS m FROM mo),
        p AS (SELECT min(x) AS p, max(m) AS m FROM c, range(2, 2000) AS r(x) WHERE x >= m AND NOT EXISTS (SELECT 1 FROM range(2, 45) AS d(y) WHERE y < x AND x % y = 0)),
        w AS (SELECT t.topic, greatest(1, coalesce(d.n, 0)) AS want, concat('0x', substr(md5('5:' || t.topic || ':a'), 1, 8))::BIGINT AS ha, concat('0x', substr(md5('5:' || t.topic || ':b'), 1, 8))::BIGINT AS hb
          FROM (SELECT DISTINCT topic FROM im) t LEFT JOIN (SELECT topic, count(DISTINCT module) AS n FROM ed GROUP BY 1) d ON d.topic = t.topic),
        v AS (SELECT topic, want, k, ((ha % (p - 1) + 1) * k + hb % p) % p AS i FROM w, p, range(2000) AS x(k) WHERE k < p),
        s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY k) AS rn FROM v, c WHERE i < m)
        SELECT topic, module, round((1.0 / want)::DOUBLE, 6) + 0.0 AS weight FROM s JOIN mo USING (i) WHERE rn <= want)""",
        ed=GR["ed"], im=GR["im"],
    ),
)
def _(t: Tables):
    return Pr.random_allocation(importance_of(t), edges_of(t), 5).withColumn("weight", rounded("weight"))


@query(
    "i3_propagation_checks",
    sql(
        f"""SELECT scope, topic, n IS NOT NULL AS mapped, coalesce(n, 0) AS module_count, {r("value", "input")}, {r("CASE WHEN n IS NULL THEN 0 ELSE value END", "output")}, {r("0", "conservation_error")}
        FROM im LEFT JOIN (SELECT topic, count(*) AS n FROM al_p GROUP BY topic) USING (topic)""",
        ed=GR["ed"], im=GR["im"], al_p=GR["al_p"],
    ),
)
def _(t: Tables):
    out = Pr.propagation_checks(importance_of(t), edges_of(t), "producer_only")
    return out.withColumns({c: rounded(c) for c in ("input", "output", "conservation_error")})


@query(
    "e11_mapping_coverage",
    sql(
        """SELECT topic, count(DISTINCT module) FILTER (role = 'publisher') AS publishers, count(DISTINCT module) FILTER (role = 'subscriber') AS subscribers, count(DISTINCT module) AS modules,
        count(DISTINCT module) FILTER (role = 'publisher') > 0 AS has_publisher, count(DISTINCT module) FILTER (role = 'subscriber') > 0 AS has_subscriber
        FROM (SELECT DISTINCT p_brand AS topic FROM part) LEFT JOIN ed USING (topic) GROUP BY topic""",
        ed=GR["ed"],
    ),
)
def _(t: Tables):
    return Pr.mapping_coverage(t.part.select(F.col("p_brand").alias("topic")), edges_of(t))


@query("j1_dense_rank", sql("SELECT scope, mode, module, rank FROM rk", **GR))
def _(t: Tables):
    scored = rankings_of(t).drop("rank")
    return Pr.dense_rank_by(scored, ["scope", "mode"], "score").select("scope", "mode", "module", "rank")


_PROP = "SELECT *, floor(score) AS s0 FROM ms"


@query("j2_ordinal_rank", sql("SELECT scope, mode, module, row_number() OVER (PARTITION BY scope, mode ORDER BY floor(score) DESC, module) AS rank FROM ms", **GR))
def _(t: Tables):
    return Pr.ordinal_rank_by(rankings_of(t), ["scope", "mode"], [F.floor("score").desc(), F.col("module")]).select("scope", "mode", "module", "rank")


@query(
    "j3_conservative_rank",
    sql(
        f"""SELECT scope, mode, module, {r("s0", "score")}, CASE WHEN s0 > 1e-12 THEN (SELECT count(*) FROM p o WHERE o.scope = p.scope AND o.mode = p.mode AND o.s0 >= p.s0 - 1e-12) END AS rank FROM p""",
        **GR, p="SELECT *, greatest(0.0, floor(score / 4) - 2)::DOUBLE AS s0 FROM ms",
    ),
)
def _(t: Tables):
    ties = rankings_of(t).withColumn("score", F.greatest(F.lit(0.0), F.floor(F.col("score") / 4) - 2).cast("double"))
    out = Pr.conservative_rank(ties, ["scope", "mode"])
    return out.select("scope", "mode", "module", rounded("score").alias("score"), "rank")


@query("j4_share_of_total", sql(f"SELECT scope, topic, {r('value', 'value')}, {r('value / sum(value) OVER (PARTITION BY scope)', 'share')} FROM im", im=GR["im"]))
def _(t: Tables):
    return I.share_of_total(importance_of(t), "value", ["scope"]).withColumns({"value": rounded("value"), "share": rounded("share")})


_DEG = {
    "dg": "SELECT m.scope, m.module, m.score AS raw, coalesce(d.n, 1) AS topics, m.score / coalesce(d.n, 1) AS score FROM ms m LEFT JOIN (SELECT module, count(DISTINCT topic) AS n FROM ed WHERE role = 'publisher' GROUP BY 1) d USING (module) WHERE m.mode = 'bidirectional'",
}


@query(
    "j5_degree_normalized",
    sql(
        f"""SELECT scope, module, topics, {r("raw", "raw")}, {r("score", "score")}, {r("score / sum(score) OVER (PARTITION BY scope)", "share")}, dense_rank() OVER (PARTITION BY scope ORDER BY score DESC) AS rank FROM dg""",
        **GR, **_DEG,
    ),
)
def _(t: Tables):
    edges = edges_of(t)
    scores = Pr.propagate(importance_of(t), edges, "bidirectional").select("scope", "module", "score")
    out = Pr.degree_normalized(scores, edges.filter("role = 'publisher'"))
    return out.select("scope", "module", "topics", rounded("raw").alias("raw"), rounded("score").alias("score"), rounded("share").alias("share"), "rank")


_CMP = {
    "a": "SELECT scope, module, score, row_number() OVER (PARTITION BY scope ORDER BY score DESC, module) AS rn FROM ms WHERE mode = 'producer_only'",
    "b": "SELECT scope, module, score, row_number() OVER (PARTITION BY scope ORDER BY score DESC, module) AS rn FROM ms WHERE mode = 'consumer_only'",
    "j": "SELECT coalesce(a.scope, b.scope) AS scope, a.score AS x, b.score AS y, a.rn AS ra, b.rn AS rb FROM a FULL JOIN b ON a.scope = b.scope AND a.module = b.module",
    "kk": "SELECT scope, k, count(*) FILTER (ra <= k AND rb <= k) AS overlap, count(*) FILTER (coalesce(ra <= k, false) OR coalesce(rb <= k, false)) AS u FROM j, (VALUES (1::BIGINT), (3), (5), (10)) AS v(k) GROUP BY ALL",
    "rr": "SELECT scope, rank() OVER (PARTITION BY scope ORDER BY x DESC) + (count(*) OVER (PARTITION BY scope, x) - 1) / 2.0::DOUBLE AS p,"
    " rank() OVER (PARTITION BY scope ORDER BY y DESC) + (count(*) OVER (PARTITION BY scope, y) - 1) / 2.0::DOUBLE AS q FROM j WHERE x IS NOT NULL AND y IS NOT NULL",
}


@query(
    "j6_compare_rankings",
    sql(
        f"""SELECT scope, k, overlap, {r("CASE WHEN u = 0 THEN 1 ELSE overlap / u END", "jaccard")}, {r("rho", "spearman")}, n AS common_items FROM kk JOIN
        (SELECT scope, corr(p, q) AS rho, count(*) AS n FROM rr GROUP BY scope) USING (scope)""",
        **GR, **_CMP,
    ),
)
def _(t: Tables):
    imp, edges = importance_of(t), edges_of(t)
    a, b = (Pr.propagate(imp, edges, m).select("scope", "module", "score") for m in ("producer_only", "consumer_only"))
    return Pr.compare_rankings(a, b, (1, 3, 5, 10)).withColumns({"jaccard": rounded("jaccard"), "spearman": rounded("spearman")})


@query("c4_rank_changes", sql("SELECT scope, module, a.rn AS rank_before, b.rn AS rank_after, b.rn - a.rn AS rank_change FROM a FULL JOIN b USING (scope, module)", **GR, a=_CMP["a"].replace("'producer_only'", "'producer_only' AND module <> 'm3'"), b=_CMP["b"]))
def _(t: Tables):
    imp, edges = importance_of(t), edges_of(t)
    a, b = (Pr.propagate(imp, edges, m).select("scope", "module", "score") for m in ("producer_only", "consumer_only"))
    order = [F.col("score").desc(), F.col("module")]
    return Pr.rank_changes(
        Pr.ordinal_rank_by(a.filter("module <> 'm3'"), ["scope"], order), Pr.ordinal_rank_by(b, ["scope"], order), ["scope", "module"]
    )


@query("c5_edge_recall", sql(f"SELECT count(*) AS edges, {r('avg((c.topic IS NOT NULL)::INT)', 'recall')} FROM (SELECT topic, module FROM ed WHERE role = 'publisher') p LEFT JOIN (SELECT topic, module FROM ed WHERE role = 'subscriber') c ON c.topic = p.topic AND c.module = p.module", ed=GR["ed"]))
def _(t: Tables):
    e = edges_of(t)
    return Tx.edge_recall(e.filter("role = 'publisher'"), e.filter("role = 'subscriber'"), ["topic", "module"]).withColumn("recall", rounded("recall"))


@query(
    "j7_top_rows",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, {r("l_extendedprice", "price")}, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5""",
)
def _(t: Tables):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return I.top_rows(t.lineitem, ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", rounded("l_extendedprice").alias("price"), "rank")


@query("j8_argmax_row", f"""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, {r("max(o_totalprice)", "o_totalprice")} FROM orders GROUP BY 1""")
def _(t: Tables):
    out = Pr.argmax_row(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")
    return out.withColumn("o_totalprice", rounded("o_totalprice"))


_TK = """WITH s AS (SELECT o_custkey AS run, year(o_orderdate) AS w, 'm' || (l_suppkey % 25) AS module, 'm' || (o_custkey % 25) AS truth, sum(l_quantity) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY run, w ORDER BY score DESC, module) AS rk FROM s)"""


@query("j9_time_to_topk", f"{_TK} SELECT run, {r('min(w) FILTER (module = truth AND rk <= 3 AND w >= 1997) - 1997', 'delay')} FROM k GROUP BY run")
def _(t: Tables):
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    s = j.groupBy(
        F.col("o_custkey").alias("run"), F.year("o_orderdate").alias("w"), F.concat(F.lit("m"), F.col("l_suppkey") % 25).alias("module"),
        F.concat(F.lit("m"), F.col("o_custkey") % 25).alias("truth"),
    ).agg(F.sum("l_quantity").alias("score"))
    return Pr.time_to_topk(s.withColumn("t", F.col("w").cast("double")), 1997.0, 3).withColumn("delay", rounded("delay"))


_TOKEN = r"<([a-z0-9]+)>"
_PUB, _SUB = ("href", "</p"), ("<li", "</a", "src=")


def pages_of(t: Tables):
    return t.pages.select(F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("text"))


def _last(hints) -> str:
    arms = [f"CASE WHEN contains(ctx, '{h}') THEN length(regexp_extract(ctx, '(?s)^(.*){h}', 1)) ELSE -1 END" for h in hints]
    return f"greatest({', '.join(arms)})"


@query(
    "j10_extract_edges",
    f"""WITH f AS (SELECT regexp_replace(url, '^https?://', '') AS path, html AS text FROM pages),
    p AS (SELECT *, string_split_regex(text, '{_TOKEN}') AS parts, regexp_extract_all(text, '{_TOKEN}', 1) AS toks, regexp_extract_all(text, '{_TOKEN}', 0) AS whole FROM f),
    o AS (SELECT path, text, parts, toks, whole, unnest(range(1, len(toks) + 1)) AS i FROM p),
    q AS (SELECT path, text, toks[i] AS topic, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b, length(whole[i]) AS l FROM o),
    c AS (SELECT path, topic, substr(text, greatest(0, b - 500) + 1, b + l - greatest(0, b - 500)) AS ctx FROM q),
    e AS (SELECT *, {_last(_PUB)} AS pp, {_last(_SUB)} AS sp FROM c)
    SELECT DISTINCT topic, CASE WHEN pp > sp THEN 'publisher' ELSE 'subscriber' END AS role, CASE WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS module, path AS source_file FROM e WHERE pp >= 0 OR sp >= 0""",
)
def _(t: Tables):
    return Tx.extract_edges(pages_of(t), _TOKEN, _PUB, _SUB)


def _hinted(column: str, hints) -> str:
    return "(" + " OR ".join(f"contains({column}, '{h}')" for h in hints) + ")"


@query(
    "j11_audit_edges",
    f"""WITH f AS (SELECT regexp_replace(url, '^https?://', '') AS path, html AS text FROM pages),
    p AS MATERIALIZED (SELECT *, string_split_regex(text, '{_TOKEN}') AS parts, regexp_extract_all(text, '{_TOKEN}', 1) AS toks, regexp_extract_all(text, '{_TOKEN}', 0) AS whole FROM f),
    o AS (SELECT path, text, parts, toks, whole, unnest(range(1, len(toks) + 1)) AS i FROM p),
    q AS MATERIALIZED (SELECT path, text, toks[i] AS topic, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b, length(whole[i]) AS l FROM o),
    c AS (SELECT path, topic, substr(text, 1, b) AS pre, substr(text, b + 1, l) AS hit, substr(text, greatest(0, b - 500) + 1, b + l - greatest(0, b - 500)) AS ctx,
      substr(text, greatest(0, b - 600) + 1, b - greatest(0, b - 600)) AS head, substr(text, b + l + 1, 600) AS tail FROM q),
    e AS (SELECT path, topic, 1 + length(pre) - length(replace(pre, chr(10), '')) AS line, {_last(_PUB)} AS pp, {_last(_SUB)} AS sp,
      CASE WHEN regexp_matches(head, '[;{{}}]') THEN regexp_extract(head, '([^;{{}}]*)$', 1) ELSE pre END || hit || CASE WHEN contains(tail, ';') THEN split_part(tail, ';', 1) || ';' ELSE substr(tail, 1, 300) END AS st FROM c),
    n AS (SELECT path, topic, line, {_hinted('st', _PUB)} AS is_p, {_hinted('st', _SUB)} AS is_s,
      CASE WHEN pp < 0 AND sp < 0 THEN 'unclassified' WHEN pp > sp THEN 'publisher' ELSE 'subscriber' END AS role FROM e)
    SELECT topic, path AS source_file, line::BIGINT AS line, CASE WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS module,
      CASE WHEN is_p THEN 'publisher' ELSE 'subscriber' END AS reference_role, min(role) AS parser_role, min(role) = CASE WHEN is_p THEN 'publisher' ELSE 'subscriber' END AS role_agreement
    FROM n WHERE is_p <> is_s GROUP BY path, topic, line, is_p""",
)
def _(t: Tables):
    a = Tx.audit_edges(pages_of(t), _TOKEN, _PUB, _SUB)
    return a.select("topic", "source_file", "line", "module", "reference_role", "parser_role", "role_agreement")
