"""Splits, seeded samples and calibration folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.plans.ordered import dense_index
from gridwake.plans.quantiles import quantiles

TRAIN, VALIDATION = 0.70, 0.15


def chrono_cuts(n: Column, train: float = TRAIN, validation: float = VALIDATION) -> tuple[Column, Column]:
    train_end = F.greatest(F.lit(1), F.floor(n * F.lit(train))).cast("long")
    val_end = F.least(n, train_end + F.greatest(F.lit(1), F.floor(n * F.lit(validation)))).cast("long")
    return train_end, val_end


def split_chrono(windows: DataFrame, purge: int = 0, index: str = "w", count: str = "n_windows") -> DataFrame:
    """Chronological split per run from the dense window number and the run's window count.

    `purge` windows on each side of both boundaries belong to no split and are dropped.
    """
    train_end, val_end = chrono_cuts(F.col(count))
    w = F.col(index)
    split = F.when(w < train_end, "train").when(w < val_end, "validation").otherwise("test")
    out = windows.withColumn("split", split)
    if purge:
        near = ((w >= train_end - purge) & (w < train_end + purge)) | ((w >= val_end - purge) & (w < val_end + purge))
        out = out.filter(~near)
    return out


def hash_order(key: Column, *salt: Column) -> Column:
    """SHA-256 text key; ordering by it is a seeded permutation that does not depend on partitioning."""
    return F.sha2(F.concat_ws(":", *salt, key.cast("string")), 256)


def split_whole_runs(runs: DataFrame, seed: int, label: str = "label", key: str = "run") -> DataFrame:
    """Leave-run-out split, stratified by label, ordered by sha256("seed:label:key").

    The first hash digits are uniform, so they serve as ordered chunks of the permutation.
    """
    hashed = runs.withColumn("_h", hash_order(F.col(key), F.lit(str(seed)), F.col(label)))
    hashed = hashed.withColumn("_hc", F.substring("_h", 1, 2))
    placed = dense_index(hashed, [label], ["_hc"], [F.col("_h"), F.col(key)], "pos")
    train_end, val_end = chrono_cuts(F.col("pos_total"))
    split = F.when(F.col("pos") < train_end, "train").when(F.col("pos") < val_end, "validation").otherwise("test")
    return placed.withColumn("split", split).drop("_h", "_hc", "pos", "pos_total")


def first_label(intervals: DataFrame, runs: DataFrame, default: str = "Normal") -> DataFrame:
    """Class of a run's first interval in document order."""
    first = intervals.groupBy("run").agg(F.min_by("class", "ordinal").alias("label"))
    return runs.join(first, "run", "left").withColumn("label", F.coalesce("label", F.lit(default)))


def hash_sample(df: DataFrame, n: int, seed: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """`n` rows per group without replacement: those with the smallest seeded hash of the key.

    Rank-limited windows are cut per task before the shuffle, so a hot group ships at most
    `n` rows per task.
    """
    hashed = df.withColumn("_h", hash_order(F.col(key), F.lit(str(seed))))
    if not by:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    w = Window.partitionBy(*by).orderBy("_h", key)
    return hashed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_h", "_rn")


def reference_vector(sample: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Median per feature of a sample; features without a finite value give 0."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    med = quantiles(sample.withColumn(value, finite), by, value, {"median": (0.5, "linear")})
    return sample.select(*by).distinct().join(med, list(by), "left").select(
        *by, F.coalesce("median", F.lit(0.0)).alias("median")
    )


def fold_totals(runs: DataFrame, sums: Sequence[str] = (), source: str = "source") -> DataFrame:
    """Rows (`runs`) and sums of the calibration part of every leave-one-source-out fold; `fold` is the held-out source.

    A fold's calibration part is everything but its own source, so its figures are the totals less the
    source's own and no row is repeated per fold. Thresholds of folds: `leave_out_quantiles`. A fold
    without calibration rows has no row.
    """
    names = ["runs", *sums]
    own = runs.groupBy(source).agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in sums])
    total = own.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("t")).scalar()
    out = own.withColumn("_t", total).select(F.col(source).alias("fold"), *[(F.col("_t")[c] - F.coalesce(c, F.lit(0))).alias(c) for c in names])
    return out.filter("runs > 0")


def weak_labels(annotations: DataFrame, unknown: str = "Uncategorized", normal: str = "Normal") -> DataFrame:
    """`unknown` when any class is uncategorised, `normal` when Normal is the only class, else NULL."""
    sets = annotations.groupBy("run").agg(F.collect_set("class").alias("c"))
    kind = F.when(F.array_contains("c", unknown), "unknown").when(
        (F.size("c") == 1) & F.array_contains("c", normal), "normal"
    )
    return sets.select("run", kind.alias("kind"))
