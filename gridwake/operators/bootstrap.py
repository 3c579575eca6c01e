"""Reproducible cluster bootstraps on pre-aggregated group statistics.

Draws come from MD5 text, so they do not depend on partitioning and repeat exactly after a
lost task.  Rows are never resampled: each group's statistics meet its weights of all replicates as
one array, and a task adds up statistics times weights for all replicates at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from gridwake.operators.metrics import class_metrics, confusion
from gridwake.plans.ordered import dense_index, prefix_sums, value_cuts, with_range_chunk
from gridwake.session import parallelism, stage


def hash_draw(*parts: Column) -> Column:
    """Uniform 32-bit integer from the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def bootstrap_weights(groups: DataFrame, reps: int, seed: int | str, group: str = "group") -> DataFrame:
    """`(rep, group, weight)`: every replicate draws as many groups as there are, with replacement."""
    # numbered twice below: the rows are reduced to their groups once
    distinct = stage(groups.select(group).distinct()).withColumn("_h", F.md5(F.col(group).cast("string")))
    distinct = distinct.withColumn("_hc", F.substring("_h", 1, 2))
    indexed = stage(dense_index(distinct, [], ["_hc"], [F.col("_h"), F.col(group)], "_i").select(group, "_i", F.col("_i_total").alias("_n")))
    # a few rows make many draws: dealt out first, or they would all be drawn by one task
    dealt = indexed.repartition(parallelism(groups.sparkSession), "_i")
    draws = dealt.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    draws = draws.select("rep", (hash_draw(F.lit(str(seed)), F.col("rep"), F.col("_i")) % F.col("_n")).alias("_i"))
    counted = draws.groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("weight"))
    # the planner does not see how many draws a row makes and would broadcast them
    return counted.hint("merge").join(indexed.select(group, "_i"), "_i").select("rep", group, "weight")


def interval(values: DataFrame, value: str, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Mean and percentile interval of the replicates (their number is a parameter)."""
    alpha = (1 - confidence) / 2
    return values.groupBy(*by).agg(
        F.avg(value).alias("bootstrap_mean"),
        F.percentile(value, F.lit(alpha)).alias("ci_low"),
        F.percentile(value, F.lit(1 - alpha)).alias("ci_high"),
        F.count(value).alias("replicates"),
    )


def grouped_bootstrap(
    stats: DataFrame, weights: DataFrame, metric: Callable[[DataFrame], DataFrame], value: str, confidence: float = 0.95
) -> DataFrame:
    """Interval of any metric that works on group statistics with a `weight` column, per `rep`."""
    units = weights.select(F.count_distinct("group")).scalar()
    return interval(metric(stats.join(weights, "group")), value, confidence=confidence).withColumn("units", units)


#: Rows that share one copy of their group's weights, lists multiplied at a time, and keys whose totals a task holds before it hands them on.
SHARED, BLOCK, HELD = 4096, 64, 1024


def _listed(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """`(keys, _items)`: the rows of each group in lists of about `SHARED`, so a large group makes many."""
    rows = stage(rows.select(*keys, *fields))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("_lists"))
    part = F.pmod(F.xxhash64(*fields), F.col("_lists")).alias("_part")
    dealt = rows.join(sizes, list(keys)).select(*keys, part, F.struct(*fields).alias("_item"))
    return dealt.groupBy(*keys, "_part").agg(F.collect_list("_item").alias("_items")).drop("_part")


def _weight_matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of (rep, weight) as a row of weights each."""
    flat = lists.flatten()
    rep = flat.field("rep").to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(rep.max(initial=-1)) + 1), np.int64)
    out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), rep] = flat.field("weight").to_numpy(zero_copy_only=False)
    return out


def _added(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sum of two vectors; the shorter one ends in zeros."""
    size = max(len(old), len(new))
    return np.pad(old, (0, size - len(old))) + np.pad(new, (0, size - len(new)))


def weighted_totals(rows: DataFrame, weights: Mapping[str, DataFrame], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`(by, rep)` and the sums of each column of `sums` times the row's weight in the replicate.

    `weights` has a table `(rep, <key>, weight)` per key column of `rows`; several weights are
    multiplied. Lists of a group's rows meet its weights as one array, tasks add up matrix products per
    `by`, and only these totals are shuffled: no row per row and replicate is ever made. A replicate in
    which no row of a `by` has weight gives no row.
    """
    listed = _listed(rows, list(weights), [*by, *sums])
    arrays = [f"_w{k}" for k in range(len(weights))]
    for name, (key, table) in zip(arrays, weights.items(), strict=True):
        pair = F.struct(F.col("rep").cast("int").alias("rep"), F.col("weight").cast("int").alias("weight"))
        listed = listed.join(table.groupBy(key).agg(F.collect_list(pair).alias(name)), key)
    whole = {c: isinstance(rows.schema[c].dataType, (LongType, IntegerType)) for c in sums}
    parts = StructType([*[rows.schema[c] for c in by], StructField("rep", LongType()), *[StructField(c, LongType() if whole[c] else DoubleType()) for c in sums]])
    types = [to_arrow_type(parts[c].dataType) for c in by]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for key, (seen, *totals) in held.items():
            rep = np.flatnonzero(seen)
            columns = [pa.array([v] * len(rep), kind) for v, kind in zip(key, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rep, pa.int64()), *[pa.array(x[rep]) for x in totals]], parts.names)
        held.clear()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                each = [_weight_matrix(part.column(a)) for a in arrays]
                reps = min(x.shape[1] for x in each)
                weight = np.multiply.reduce([x[:, :reps] for x in each])
                items = part.column("_items")
                owner = np.repeat(np.arange(part.num_rows), items.value_lengths().to_numpy(zero_copy_only=False))
                flat = items.flatten()
                values = [flat.field(c).to_numpy(zero_copy_only=False) for c in sums]
                places: dict[tuple, list[int]] = {}
                for k, key in enumerate(zip(*[flat.field(c).to_pylist() for c in by], strict=True) if by else [()] * len(flat)):
                    places.setdefault(key, []).append(k)
                for key, mine in places.items():
                    w = weight[owner[mine]]
                    new = [w.sum(axis=0), *[v[mine] @ w for v in values]]
                    held[key] = [_added(x, y) for x, y in zip(held[key], new, strict=True)] if key in held else new
                if len(held) > HELD:
                    yield from flush(held)
        yield from flush(held)

    totals = listed.select("_items", *arrays).mapInArrow(multiply, parts)
    return totals.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in sums])


def macro_f1_replicates(preds: DataFrame, weights: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Macro-F1 per replicate from per-group confusion counts."""
    cells = ["true_class", "predicted_class"]
    weighted = weighted_totals(confusion(preds, [*by, "group"]), {"group": weights}, ["n"], [*by, *cells])
    return class_metrics(weighted, labels, [*by, "rep"]).select(*by, "rep", "macro_f1")


def ap_replicates(scores: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted average precision with ties per replicate; NULL without positive weight."""
    cuts = value_cuts(scores, "score")
    per = scores.groupBy(*by, "group", "score").agg(F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    at = weighted_totals(per, {"group": weights}, ["pos", "n"], [*by, "score"])
    keys = [*by, "rep"]
    curve = prefix_sums(
        with_range_chunk(at, "score", cuts), keys, ["_chunk"], [F.col("score").desc()], {"tp": F.col("pos"), "seen": F.col("n")}, descending_chunks=True
    )
    ap = F.try_divide(F.sum(F.col("pos") * F.try_divide(F.col("tp").cast("double"), F.col("seen"))), F.max("tp_total"))
    return curve.groupBy(*keys).agg(ap.alias("auprc"))


def paired_difference(replicates: DataFrame, name: str, first: str, second: str, value: str, by: Sequence[str] = ("rep",)) -> DataFrame:
    """first - second per replicate; both sides must come from one weight table."""
    pick = lambda which: F.max(F.when(F.col(name) == which, F.col(value)))
    return replicates.groupBy(*by).agg((pick(first) - pick(second)).alias("difference"))


def pooled_replicates(replicates: DataFrame, value: str, by: Sequence[str] = ("rep",)) -> DataFrame:
    """Average of a replicate over seeds."""
    return replicates.groupBy(*by).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("seeds"))


def require_same_groups(frame: DataFrame, seed: str = "seed", group: str = "group") -> DataFrame:
    """The frame itself; fails when a cluster is missing from some seed."""
    total = frame.select(F.count_distinct(seed)).scalar()
    per = frame.groupBy(group).agg(F.count_distinct(seed).alias("_s"))
    ok = F.when(F.col("_s") == total, F.lit(True)).otherwise(F.raise_error(F.lit("clusters differ between seeds")).cast("boolean"))
    return frame.join(per.withColumn("_ok", ok).filter("_ok").select(group), group, "left_semi")


def two_way_replicates(cells: DataFrame, reps: int, seed: int, row: str, column: str, value: str) -> DataFrame:
    """Mean of the matrix with rows and columns resampled independently."""
    drawn = {row: bootstrap_weights(cells, reps, f"{seed}r", row), column: bootstrap_weights(cells, reps, f"{seed}c", column)}
    both = weighted_totals(cells.select(row, column, F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_n")), drawn, ["_v", "_n"])
    return both.select("rep", (F.col("_v") / F.col("_n")).alias("estimate"))


def pivot_complete(df: DataFrame, row: str, column: str, columns: Sequence, value: str) -> DataFrame:
    """Row x column matrix; a missing cell fails the job."""
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    return wide.withColumns(
        {
            str(c): F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")).otherwise(F.raise_error(F.lit(f"missing cell in {c}")).cast("double"))
            for c in columns
        }
    )


def sign_flip_p(clusters: DataFrame, value: str = "difference", max_clusters: int = 32) -> DataFrame:
    """Exact two-sided sign-flip test: share of the 2^m sign patterns at least as extreme.

    `clusters` holds one row per cluster. Every task takes a stretch of the patterns, so the test
    is as wide as the cluster has cores; its cost doubles with each row, which `max_clusters` guards.
    """
    spark = clusters.sparkSession
    found = clusters.select(value).limit(max_clusters + 1).count()
    if found > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters: 2^m sign patterns cannot be enumerated")
    observed = clusters.select(F.array_sort(F.collect_list(value))).scalar()
    patterns = spark.range(1 << found).select("id", observed.alias("_d"))
    flipped = F.transform("_d", lambda x, i: F.when(F.call_function("shiftright", F.col("id"), i).bitwiseAND(F.lit(1)) == 1, -x).otherwise(x))
    total = lambda values: F.abs(F.aggregate(values, F.lit(0.0), lambda a, v: a + v))
    sums = patterns.select(total(flipped).alias("_t"), total("_d").alias("_o"))
    return sums.agg(
        F.lit(found).cast("long").alias("clusters"), (F.max("_o") / found).alias("mean_abs"), F.avg(F.when(F.col("_t") >= F.col("_o") - 1e-12, 1.0).otherwise(0.0)).alias("p_value")
    )
