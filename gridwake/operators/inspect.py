"""Descriptive audits and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import is_finite, ratio0
from gridwake.plans.quantiles import quantiles
from gridwake.session import stage

NORMAL_CLASSES = ("Normal", "Uncategorized")


def annotation_stats(rows: DataFrame) -> DataFrame:
    """Per class: annotations, intervals, and annotations of an anomaly class that have no range.

    `rows` holds one row per range, or a single row without bounds for a range-less annotation.
    """
    bare = F.col("start_us").isNull() & ~F.col("class").isin(*NORMAL_CLASSES)
    return rows.groupBy("class").agg(
        F.count_distinct("run", "annotation_index").alias("annotations"),
        F.count("start_us").alias("intervals"),
        F.sum(bare.cast("long")).alias("without_range"),
    )


def label_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("windows"))


def seed_summary(metrics: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation over seeds; NULLs are dropped and one run has deviation 0."""
    return metrics.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("runs"),
    )


def majority_value(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most common value (ties: smallest), its count and the number of distinct values."""
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v")))
    return counted.groupBy(*by).agg(best.alias("b"), F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("rows")).select(
        *by, F.col("b.v").alias("majority"), (-F.col("b.m")).alias("majority_count"), "distinct_values", "rows"
    )


def effect_checks(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Baseline against fault after onset: did the injected change take effect?

    `samples`: `condition` (baseline/fault), `post` flag, `hit` flag, `value`, `t`.
    """
    def stats(cond: str) -> dict[str, Column]:
        on = (F.col("condition") == cond) & F.col("post")
        return {
            f"{cond}_fraction": F.avg(F.when(on, F.col("hit").cast("double"))),
            f"{cond}_mean": F.avg(F.when(on, F.col("value"))),
            f"{cond}_std": F.stddev_pop(F.when(on, F.col("value"))),
        }

    aggs = {**stats("baseline"), **stats("fault")}
    first = F.min(F.when((F.col("condition") == "fault") & F.col("post") & F.col("hit"), F.col("t")))
    out = samples.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()], first.alias("first_hit"))
    return out.withColumns(
        {
            "fraction_effect": (F.col("baseline_fraction") < 0.1) & (F.col("fault_fraction") > 0.9),
            "mean_effect": (F.abs("baseline_mean") < 0.1) & (F.abs("fault_mean") > 15),
            "std_effect": (F.col("baseline_std") > 0.1) & (F.col("fault_std") < 0.25 * F.col("baseline_std")),
        }
    )


def console_metrics(logs: DataFrame, fields: dict[str, str], duration: str = "duration_s", last: str = "last_s") -> DataFrame:
    """Counters found in console text by pattern, and whether the replay reached the end."""
    out = logs.withColumns(
        {n: F.expr(f"try_cast(nullif(regexp_extract(text, '{p}', 1), '') AS DOUBLE)") for n, p in fields.items()}
    )
    return out.withColumn("coverage_ok", F.coalesce(F.col(last) >= F.col(duration) - 1, F.lit(False)))


def score_audit(scores: DataFrame, features: DataFrame, by: str = "run") -> DataFrame:
    """Windows, score range and median, share of zero features, and whether all values are finite."""
    ok = is_finite("score")
    q = quantiles(scores.filter(ok), [by], "score", {"median_score": (0.5, "linear")}).drop("n")
    s = scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.min(ok).alias("_ok_s"),
    )
    f = features.groupBy(by).agg(
        F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("zero_fraction"), F.min(is_finite("value")).alias("_ok_f")
    )
    return s.join(q, by, "left").join(f, by, "left").withColumn(
        "all_finite", F.col("_ok_s") & F.coalesce(F.col("_ok_f"), F.lit(True))
    ).drop("_ok_s", "_ok_f")


def leakage_audit(windows: DataFrame, group: str = "run") -> DataFrame:
    """Groups that occur in two splits, per pair of splits, and the largest split count of a group."""
    sets = windows.groupBy(group).agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> concat(a, '/', b))))")
    return sets.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("shared_groups"))


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Largest absolute difference of two stores on common keys, and rows present on one side only."""
    left = a.select(*keys, F.col(value).alias("_a"))
    right = b.select(*keys, F.col(value).alias("_b"))
    j = left.join(right, list(keys), "full")
    return j.groupBy(*by).agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_error"),
        F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("unmatched"),
        F.count(F.lit(1)).alias("rows"),
    )


def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Value over its group total (0 when the total is 0); totals are pre-aggregated, then joined."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    if by:
        joined = df.join(totals, list(by))
        return joined.withColumn(name, ratio0(value, "_total")).drop("_total")
    return df.withColumn(name, ratio0(F.col(value), totals.scalar()))


def gain_share(importance: DataFrame, by: str = "channel", value: str = "gain") -> DataFrame:
    gains = importance.groupBy(by).agg(F.sum(value).alias(value))
    return share_of_total(gains, value)


def availability(valid: DataFrame, by: Sequence[str] = ("run", "channel")) -> DataFrame:
    return valid.groupBy(*by).agg(F.avg(F.col("valid").cast("double")).alias("availability"))


def availability_summary(avail: DataFrame, by: Sequence[str]) -> DataFrame:
    avail = stage(avail)
    q = quantiles(avail, by, "availability", {"median": (0.5, "linear")})
    m = avail.groupBy(*by).agg(F.avg("availability").alias("mean"))
    return m.join(q, list(by))


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per group; the rank limit is applied per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)
