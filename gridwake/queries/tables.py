"""Sources, sinks, integrity and relational building blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridwake.functions.numeric import rounded
from gridwake.functions.text import field_of, pair_key, run_part, topic_of
from gridwake.operators import samples as S
from gridwake.queries.calibration import _MANIFEST, manifest_of
from gridwake.queries.registry import Tables, query
from gridwake.queries.sqlkit import r, sql
from gridwake.session import parallelism, shared_dir
from gridwake.sources import annotations as A
from gridwake.sources import integrity as N
from gridwake.sources import tables as Tb


def documents_of(t: Tables):
    """One annotation document line per event: large errors carry two ranges, one of them reversed."""
    e = t.events
    ts = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    later = (F.unix_micros(F.col("ts").cast("timestamp")) + 1000).cast("string")
    ranges = F.concat(
        F.lit('[["s1",[['), ts, F.lit(","), later, F.lit('],[1],null]],null,["x"],["s2",[['), later, F.lit(","), ts, F.lit("]]]]")
    )
    has = (F.col("event_type") == "error") & (F.col("value") >= 50)
    note = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit('"note":"seen, \\"late\\" }'), F.col("event_id"), F.lit('","timestamp":'), ts, F.lit(",")))
    body = F.concat(
        F.lit('"'), F.col("event_id").cast("string"), F.lit('":{"annotations":[{"class":"'), F.col("event_type"), F.lit('",'), note, F.lit('"ranges":'),
        F.when(has, ranges).otherwise(F.lit("[]")), F.lit("}]}"),
    )
    return e.select("event_id", body.alias("entry"))


def stored_documents(t: Tables):
    path = shared_dir(t.spark)
    documents_of(t).select(F.concat(F.lit("{"), "entry", F.lit("}"))).write.text(path)
    return A.read_annotations(t.spark, path, lines=True)


def stored_objects(t: Tables):
    """Files of one JSON object each, with the entries of 2,000 events; ranges are far smaller than a file."""
    path = shared_dir(t.spark)
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "entry"))), lambda x: x["entry"]), ",\n  ")
    objects = documents_of(t).groupBy(F.floor(F.col("event_id") / 2000)).agg(F.concat(F.lit("{\n  "), entries, F.lit("\n}")).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return A.read_annotations(t.spark, path, step=1 << 16)


@query("a1_read_annotations", "SELECT event_id::VARCHAR AS run, event_type = 'error' AND value >= 50 AS has_range FROM events")
def _(t: Tables):
    return stored_objects(t).select("run", F.col("document").contains('"s1"').alias("has_range"))


_RANGES = """SELECT event_id::VARCHAR AS run, event_type AS class, sig AS signal, epoch_us(ts) AS start_us, epoch_us(ts) + 1000 AS end_us, i AS range_index FROM events,
  (VALUES ('s1', 0), ('s2', 1)) AS v(sig, i) WHERE event_type = 'error' AND value >= 50"""


@query("a2_flatten_intervals", f"SELECT run, 0::INT AS annotation_index, class, signal, start_us, end_us FROM ({_RANGES})")
def _(t: Tables):
    return A.flatten_intervals(stored_documents(t))


@query(
    "a3_annotation_rows",
    f"""SELECT run, 0 AS annotation_index, class, CASE WHEN run::BIGINT % 3 = 0 THEN '' ELSE 'seen, "late" }}' || run END AS note,
    CASE WHEN run::BIGINT % 3 = 0 THEN '' ELSE us::VARCHAR END AS annotated_at, range_index, signal, start_us, end_us FROM
    (SELECT *, start_us AS us FROM ({_RANGES}) UNION ALL
    SELECT event_id::VARCHAR, event_type, NULL, NULL, NULL, NULL, epoch_us(ts) FROM events WHERE NOT (event_type = 'error' AND value >= 50))""",
)
def _(t: Tables):
    return A.annotation_rows(stored_documents(t))


@query(
    "a4_read_numeric",
    f"""SELECT l_orderkey::DOUBLE AS key, {r("CASE WHEN l_linenumber = 3 OR l_linenumber = 4 THEN NULL ELSE l_extendedprice END", "price")} FROM lineitem""",
)
def _(t: Tables):
    path = shared_dir(t.spark)
    price = F.when(F.col("l_linenumber") == 3, "bad").when(F.col("l_linenumber") == 4, "NaN").otherwise(F.col("l_extendedprice").cast("string"))
    t.lineitem.select(F.col("l_orderkey").alias("key"), "l_comment" if "l_comment" in t.lineitem.columns else "l_shipdate", price.alias("price")).write.option(
        "header", True
    ).option("sep", "\t").csv(path)
    return Tb.read_numeric(t.spark, path, ["key", "price"], "\t").withColumn("price", rounded("price"))


@query("a5_read_table", f"SELECT c_custkey, c_mktsegment, {r('c_acctbal', 'c_acctbal')} FROM customer")
def _(t: Tables):
    df = Tb.read_table(t.spark, f"{t.path}/customer.parquet", "c_custkey BIGINT, c_mktsegment STRING, c_acctbal DOUBLE")
    return df.withColumn("c_acctbal", rounded("c_acctbal"))


@query(
    "a6_write_rows",
    """SELECT 'supplier' AS kind, s_suppkey::VARCHAR AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey::VARCHAR, NULL, c_mktsegment FROM customer""",
)
def _(t: Tables):
    path = shared_dir(t.spark)
    a = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    b = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    Tb.write_rows([a, b], path)
    return t.spark.read.option("header", True).csv(path)


@query("a7_feature_store", f"SELECT l_linestatus AS split, count(*) AS rows, {r('sum(l_quantity)', 'total')} FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def _(t: Tables):
    path = shared_dir(t.spark)
    Tb.write_features(t.lineitem.withColumn("split", F.col("l_linestatus")), path)
    return t.spark.read.parquet(path).filter("split = 'O'").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("l_quantity")).alias("total"))


@query(
    "a7_bucketed_join",
    f"""SELECT l.orderkey, l.lines, {r("l.quantity", "quantity")}, {r("o.o_totalprice", "price")} FROM
    (SELECT l_orderkey AS orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l JOIN orders o ON o.o_orderkey = l.orderkey""",
)
def _(t: Tables):
    """Two stores bucketed alike are grouped and joined by their key without an exchange."""
    name, n = f"store_{uuid.uuid4().hex}", parallelism(t.spark)
    lines = Tb.write_bucketed(t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_quantity"), f"{name}_lines", n, "orderkey", shared_dir(t.spark))
    orders = Tb.write_bucketed(t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_totalprice"), f"{name}_orders", n, "orderkey", shared_dir(t.spark))
    sums = lines.groupBy("orderkey").agg(F.count(F.lit(1)).alias("lines"), rounded(F.sum("l_quantity")).alias("quantity"))
    return sums.hint("merge").join(orders, "orderkey").select("orderkey", "lines", "quantity", rounded("o_totalprice").alias("price"))


@query("a8_materialize_if_stale", f"SELECT o_orderstatus, count(*) AS rows, {r('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1")
def _(t: Tables):
    """A first version with fewer columns is stale, the second is kept."""
    path = shared_dir(t.spark)
    Tb.materialize_if_stale(t.orders.drop("o_orderpriority"), path)
    first = Tb.materialize_if_stale(t.orders, path)
    again = Tb.materialize_if_stale(t.orders, path, first.count())
    return again.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("o_totalprice")).alias("total"))


#: All tables of a directory.
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("a9_hash_manifest")
def _(t: Tables):
    m = N.hash_manifest(t.spark, [f"{t.path}/{n}.parquet" for n in NAMES])
    home = t.path.rstrip("/").rpartition("/")[2]
    return m.select(F.substring_index("path", f"/{home}/", -1).alias("file"), "size", "chunks", "sha256")


@query(
    "a10_seal",
    """WITH d AS (SELECT o_orderstatus, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS d FROM orders),
    s AS (SELECT o_orderstatus, count(*) AS rows, """
    + ", ".join(f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT)::HUGEINT AS s{i}" for i in range(4))
    + """ FROM d GROUP BY 1) SELECT o_orderstatus, rows, sha256(rows || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS digest FROM s""",
)
def _(t: Tables):
    path = shared_dir(t.spark)
    preds = t.orders.select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    N.seal(preds, path)
    return N.table_digest(N.open_sealed(t.spark, path), ["o_orderstatus"])


@query("a11_write_summary", "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1")
def _(t: Tables):
    path = shared_dir(t.spark)
    Tb.write_summary(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders")), path)
    return t.spark.read.schema("status STRING, orders BIGINT").json(path)


@query(
    "b6_parse_run_id",
    f"""WITH {_MANIFEST} SELECT o_orderkey, string_split(run_id, '__')[1] AS mutation_id, string_split(run_id, '__')[2] || '__' || string_split(run_id, '__')[3] AS source_log,
    string_split(run_id, '__')[4] AS condition, regexp_replace(run_id, '__[a-z]+$', '') AS pair_key, mutation_id || '.' || source_log AS channel, mutation_id AS topic, source_log AS field FROM mf""",
)
def _(t: Tables):
    m = manifest_of(t).withColumn("channel", F.concat_ws(".", "mutation_id", "source_log"))
    return m.select(
        "o_orderkey", run_part("run_id", 0).alias("mutation_id"), F.concat_ws("__", run_part("run_id", 1), run_part("run_id", 2)).alias("source_log"),
        run_part("run_id", 3).alias("condition"), pair_key("run_id").alias("pair_key"), "channel", topic_of("channel").alias("topic"), field_of("channel").alias("field"),
    )


@query("b15_require_finite", f"SELECT l_returnflag, count(*) AS rows, {r('sum(l_quantity)', 'total')} FROM lineitem GROUP BY 1")
def _(t: Tables):
    ok = S.require_finite(t.lineitem, ["l_quantity", "l_extendedprice"]).filter("l_extendedprice >= 0")
    return ok.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("l_quantity")).alias("total"))


@query(
    "c1_join_one_to_one",
    f"""SELECT a.o_orderkey, a.o_orderstatus, {r("a.o_totalprice", "score_a")}, {r("b.q", "score_b")} FROM orders a JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey""",
)
def _(t: Tables):
    a = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("score"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("score"))
    b = b.join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    out = N.join_one_to_one(a, b, ["o_orderkey"], ["o_orderstatus"])
    return out.withColumns({"score_a": rounded("score_a"), "score_b": rounded("score_b")})


@query("c2_join_required", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t: Tables):
    return N.join_required(t.orders.select("o_orderkey", "o_custkey"), t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), ["o_custkey"])


@query("c3_enrich", "SELECT doc_id, lang, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables):
    return N.enrich(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.col("quality").cast("long").alias("quality")), ["doc_id"])


@query(
    "c6_keep_drop_groups",
    "SELECT doc_id, 'kept' AS side FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) UNION ALL SELECT doc_id, 'dropped' FROM documents ANTI JOIN (SELECT doc_id FROM labels) USING (doc_id)",
)
def _(t: Tables):
    docs = t.documents.select("doc_id")
    kept = N.keep_groups(docs, t.labels.filter("toxic = 1").select("doc_id"), ["doc_id"])
    dropped = N.drop_groups(docs, t.labels.select("doc_id"), ["doc_id"])
    return kept.withColumn("side", F.lit("kept")).unionByName(dropped.withColumn("side", F.lit("dropped")))


@query(
    "c17_scope_k",
    f"""SELECT l_returnflag AS scope, k, count(*) AS rows, {r("sum(l_quantity)", "total")} FROM lineitem, (VALUES (1::BIGINT), (3), (5)) AS v(k) WHERE l_linenumber <= k GROUP BY ALL""",
)
def _(t: Tables):
    """Scopes times k: the small parameter list is exploded next to pre-aggregated rows."""
    base = t.lineitem.groupBy(F.col("l_returnflag").alias("scope"), "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 3, 5)]))
    crossed = base.withColumn("k", ks).filter("l_linenumber <= k")
    return crossed.groupBy("scope", "k").agg(F.sum("n").alias("rows"), rounded(F.sum("q")).alias("total"))


@query(
    "o_set_operations",
    """SELECT 'union' AS op, c AS key FROM (SELECT c_custkey AS c FROM customer UNION SELECT o_custkey FROM orders) UNION ALL
    SELECT 'intersect', c FROM (SELECT c_custkey AS c FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL
    SELECT 'except', c FROM (SELECT c_custkey AS c FROM customer EXCEPT SELECT o_custkey FROM orders)""",
)
def _(t: Tables):
    return N.set_operations(t.customer.select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key")))


__all__ = ["sql"]
