"""Calibration on normal data and causal persistence gates.

Series are keyed by a run and a contiguous window number, so rolling frames are cut into
blocks with a short halo and never need a whole run in one task.  `number_rows` gives that
number to series that only have a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import as_col, floor_div, is_finite, require
from gridwake.plans.ordered import dense_index, rolling, value_cuts
from gridwake.plans.quantiles import leave_out_quantiles, quantile_higher, quantiles
from gridwake.session import stage


def number_rows(df: DataFrame, by: Sequence[str], time: str, chunk_width: int, tie: Sequence[str] = (), name: str = "w") -> DataFrame:
    chunked = df.withColumn("_chunk", floor_div(time, chunk_width))
    order = [F.col(time), *[F.col(c) for c in tie]]
    return dense_index(chunked, by, ["_chunk"], order, name).drop("_chunk", f"{name}_total")


def fit_noise(normal: DataFrame, q: float = 0.99, floor: float = 0.05, by: Sequence[str] = ("feature",), value: str = "residual") -> DataFrame:
    """Upper quantile of the pooled normal residuals per feature, floored."""
    noise = quantile_higher(normal, value, q, by, "noise")
    return noise.select(*by, F.greatest(F.col("noise"), F.lit(floor)).alias("noise"))


def _calibrated(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str, catalogued: bool = False) -> DataFrame:
    """Rows with their calibration; a row without any fails the job instead of vanishing.

    A `catalogued` table has a row per feature, channel or topic: it goes to the rows, which else would be dealt by those few keys.
    """
    joined = rows.join(F.broadcast(table) if catalogued else table, list(keys), "left")
    return joined.withColumn(value, require(F.col(value).isNotNull(), value, f"{', '.join(keys)} without {value}"))


def scaled_residual(residuals: DataFrame, noise: DataFrame) -> DataFrame:
    """Residuals in units of their feature's noise; a feature without noise fails the job."""
    return _calibrated(residuals, noise, ["feature"], "noise", True).withColumn("scaled", F.col("residual") / F.col("noise"))


def topic_residual(scaled: DataFrame, aggregation: str = "max", q: float = 0.9, by: Sequence[str] = ("run", "w", "topic"),
                   carry: Sequence[str] = ()) -> DataFrame:
    """Residual of a topic in a window over its features: `max`, upper `quantile` or `mean_top`.

    A window has at most as many values per topic as the catalogue has features.
    """
    vals = F.array_sort(F.collect_list("scaled"))
    n = F.size("_v")
    keep = [F.first(c).alias(c) for c in carry]
    if aggregation == "max":
        return scaled.groupBy(*by).agg(F.greatest(F.max("scaled"), F.lit(0.0)).alias("value"), *keep)
    grouped = scaled.groupBy(*by).agg(vals.alias("_v"), *keep)
    if aggregation == "quantile":
        pick = F.element_at("_v", (F.ceil(F.lit(q) * (n - 1)) + 1).cast("int"))
    elif aggregation == "mean_top":
        m = F.greatest(F.lit(1), F.ceil(n * F.lit(1 - q))).cast("int")
        top = F.slice("_v", n - m + 1, m)
        pick = F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / m
    else:
        raise ValueError(f"unknown aggregation {aggregation}")
    return grouped.withColumn("value", pick).drop("_v")


def window_score(topics: DataFrame, by: Sequence[str] = ("run", "w"), carry: Sequence[str] = ()) -> DataFrame:
    return topics.groupBy(*by).agg(F.max("value").alias("score"), *[F.first(c).alias(c) for c in carry])


def sustained_score(scores: DataFrame, consecutive: int, by: Sequence[str] = ("run",), index: str = "w", value: str = "score") -> DataFrame:
    """Smallest of the last `consecutive` scores, only where that many exist."""
    out = rolling(scores, by, index, consecutive, {"sustained": F.min(value), "_full": F.count(F.lit(1))})
    return out.filter(F.col("_full") == consecutive).drop("_full")


def run_maxima(scores: DataFrame, consecutive: int, by: Sequence[str] = ("run",), index: str = "w", value: str = "score") -> DataFrame:
    """Largest sustained score per run; runs shorter than the persistence give no row."""
    return sustained_score(scores, consecutive, by, index, value).groupBy(*by).agg(F.max("sustained").alias("maximum"))


def _non_empty(threshold: Column, n: Column) -> Column:
    return require(n > 0, threshold, "normal controls too short")


def fit_event_threshold(normal: DataFrame, consecutive: int = 3, minimum: float = 3.0) -> DataFrame:
    maxima = run_maxima(normal, consecutive)
    return maxima.agg(F.greatest(F.lit(minimum), F.max("maximum")).alias("_m"), F.count(F.lit(1)).alias("_n")).select(
        _non_empty(F.col("_m"), F.col("_n")).alias("threshold")
    )


def fit_event_threshold_quantile(
    normal: DataFrame, q: float = 1.0, warmup: float = 15.0, consecutive: int = 3, minimum: float = 3.0, time: str = "t"
) -> DataFrame:
    """Upper quantile of the run maxima; windows before the warm-up are dropped before persistence."""
    maxima = stage(run_maxima(normal.filter(F.col(time) >= warmup), consecutive))
    return quantile_higher(maxima, "maximum", q).select(F.greatest(F.lit(minimum), F.col("threshold")).alias("threshold"))


def fit_second_largest(maxima: DataFrame, floor: float = 3.0) -> DataFrame:
    """Second largest run maximum, equal maxima counted separately; fewer than two runs fail the job."""
    two = maxima.select("maximum").orderBy(F.col("maximum").desc()).limit(2)
    found = two.agg(F.greatest(F.lit(floor), F.min("maximum")).alias("_m"), F.count("maximum").alias("_n"))
    return found.select(require(F.col("_n") == 2, "_m", "two normal runs required").alias("threshold"))


def sustained_gate(
    scores: DataFrame, threshold, consecutive: int = 3, by: Sequence[str] = ("run",), index: str = "w", value: str = "score", name: str = "gate"
) -> DataFrame:
    """Open from the k-th consecutive crossing on (`score > threshold`), closed by any miss.

    A score that is not finite fails the job; NaN would otherwise count as a crossing.
    """
    finite = require(is_finite(value), value, "scores must be finite")
    crossed = scores.withColumn("_x", (finite > as_col(threshold)).cast("int"))
    out = rolling(crossed, by, index, consecutive, {"_hits": F.sum("_x")})
    return out.withColumn(name, F.col("_hits") == consecutive).drop("_x", "_hits")


def predict_gate(scores: DataFrame, threshold, consecutive: int = 3, warmup: float | None = 15.0, time: str = "t") -> DataFrame:
    """Persistence first, then the warm-up mask."""
    out = sustained_gate(scores, threshold, consecutive)
    return out if warmup is None else out.withColumn("gate", F.col("gate") & (F.col(time) >= warmup))


def gated_mean(rows: DataFrame, value: str, by: Sequence[str], gate: str = "gate", name: str = "evidence") -> DataFrame:
    """Mean over gated rows, 0 without any."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(gate), F.col(value))), F.lit(0.0)).alias(name))


def gated_evidence(values: DataFrame, reference: DataFrame, gate: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Mean over gated windows of `max(value - reference, 0)` per item.

    An item without reference, or a window without gate, fails the job instead of vanishing.  A reference that is
    the same in all windows has the columns `item` and `value` only.
    """
    on = [c for c in (*keys, "w", item) if c in reference.columns]
    j = _calibrated(values, reference.withColumnRenamed("value", "_ref"), on, "_ref", on == [item])
    j = _calibrated(j, gate, [*keys, "w"], "gate")
    excess = F.greatest(F.col("value") - F.col("_ref"), F.lit(0.0))
    return gated_mean(j.withColumn("_e", excess), "_e", [*keys, item])


def predict_paired(topics: DataFrame, threshold, consecutive: int = 3) -> tuple[DataFrame, DataFrame]:
    """Window gates and, per topic, the mean excess over the gated windows."""
    gates = sustained_gate(window_score(topics), threshold, consecutive)
    j = topics.join(gates.select("run", "w", "gate"), ["run", "w"])
    excess = F.greatest(F.col("value") - as_col(threshold), F.lit(0.0))
    return gates, gated_mean(j.withColumn("_e", excess), "_e", ["run", "topic"])


def fit_topic_thresholds(normal_topics: DataFrame, consecutive: int = 3, minimum: float = 3.0) -> DataFrame:
    maxima = run_maxima(normal_topics, consecutive, ["run", "topic"], value="value")
    topics = normal_topics.select("topic").distinct()
    best = maxima.groupBy("topic").agg(F.max("maximum").alias("_m"))
    return topics.join(best, "topic", "left").select("topic", F.greatest(F.lit(minimum), F.col("_m")).alias("threshold"))


def predict_paired_topics(topics: DataFrame, thresholds: DataFrame, consecutive: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each topic has its own gate; a window is gated when any topic is."""
    j = _calibrated(topics, thresholds, ["topic"], "threshold", True)
    own = sustained_gate(j, F.col("threshold"), consecutive, ["run", "topic"], value="value", name="own")
    ratio = F.col("value") / F.col("threshold")
    own = own.withColumns({"_r": ratio, "_e": F.when(F.col("own"), F.greatest(ratio - 1, F.lit(0.0))).otherwise(F.lit(0.0))})
    gates = own.groupBy("run", "w").agg(F.max("_r").alias("score"), F.max("own").alias("gate"))
    both = own.join(gates.select("run", "w", "gate"), ["run", "w"])
    return gates, gated_mean(both, "_e", ["run", "topic"])


def channel_values(scaled: DataFrame) -> DataFrame:
    return scaled.groupBy("run", "w", "channel").agg(F.max("scaled").alias("value"))


def fit_channels(normal: DataFrame, q: float = 0.99, floor: float = 1.0, min_windows: int = 3) -> DataFrame:
    """Centre: median of run medians.  Scale: largest run tail above the centre, floored."""
    cuts = value_cuts(normal, "value")
    per = quantiles(normal, ["run", "channel"], "value", {"med": (0.5, "linear"), "tail": (q, "higher")}, cuts)
    per = stage(per).withColumn("med", require(F.col("n") >= min_windows, "med", "complete healthy runs required"))
    center = quantiles(per, ["channel"], "med", {"center": (0.5, "linear")}, cuts)
    upper = per.groupBy("channel").agg(F.max("tail").alias("upper"))
    return center.join(upper, "channel").select(
        "channel", "center", F.greatest(F.col("upper") - F.col("center"), F.lit(floor)).alias("scale")
    )


def persistent_channels(z: DataFrame, consecutive: int = 3, by: Sequence[str] = ("run", "channel"), value: str = "z") -> DataFrame:
    """Rolling minimum, 0 (not absent) before the first full frame."""
    out = rolling(z, by, "w", consecutive, {"_min": F.min(value), "_n": F.count(F.lit(1))})
    return out.withColumn("persistent", F.when(F.col("_n") == consecutive, F.col("_min")).otherwise(F.lit(0.0))).drop("_min", "_n")


def predict_channels(values: DataFrame, calibration: DataFrame, threshold, consecutive: int = 3) -> tuple[DataFrame, DataFrame]:
    """Window gates (any channel above the threshold) and topic evidence over the gated windows."""
    z = _calibrated(values, calibration, ["channel"], "scale", True).withColumn(
        "z", F.greatest(F.lit(0.0), (F.col("value") - F.col("center")) / F.col("scale"))
    )
    p = persistent_channels(z, consecutive)
    thr = as_col(threshold)
    windows = p.groupBy("run", "w").agg(F.max("persistent").alias("score"), F.max(F.col("persistent") > thr).alias("gate"))
    excess = F.greatest(F.col("persistent") - thr, F.lit(0.0))
    per_topic = p.groupBy("run", "w", "topic").agg(F.max(excess).alias("_e"))
    j = per_topic.join(windows.select("run", "w", "gate"), ["run", "w"])
    return windows, gated_mean(j, "_e", ["run", "topic"])


def bank_scale(healthy: DataFrame, q: float = 0.99, floor: float = 1.0, min_valid: int = 3) -> DataFrame:
    """Scale of the healthy distances per channel; NULL (unavailable) with too few valid ones."""
    valid = healthy.filter("valid")
    tail = quantiles(valid, ["channel"], "distance", {"tail": (q, "higher")})
    scale = F.when(F.col("n") >= min_valid, F.greatest(F.lit(floor), F.col("tail")))
    return healthy.select("channel").distinct().join(tail, "channel", "left").select(
        "channel", scale.alias("scale"), F.coalesce("n", F.lit(0)).cast("long").alias("valid_count")
    )


def reassess(scores: DataFrame, fixed: float, q: float = 0.99, consecutive: int = 3) -> DataFrame:
    """Three readings of one score table: fixed threshold on all windows, fixed on fresh windows
    (`t <= last_sensor`), and a fresh threshold calibrated on the baselines of other sources.

    Rows carry `mode`, `threshold`, `gate` and `valid`.
    """
    scores = stage(scores)
    fresh = F.col("t") <= F.col("last_sensor")
    one = sustained_gate(scores, F.lit(fixed), 1)
    all_mode = one.select("*", F.lit("fixed_all").alias("mode"), F.lit(True).alias("valid"), F.lit(fixed).alias("threshold"))
    fresh_mode = one.select("*", F.lit("fixed_fresh").alias("mode"), fresh.alias("valid"), F.lit(fixed).alias("threshold"))
    base = scores.filter(F.col("is_baseline") & fresh).select("source", "score")
    thr = leave_out_quantiles(base, scores, "source", "score", q)
    joined = _calibrated(scores, thr, ["source"], "threshold")
    cal = sustained_gate(joined, F.col("threshold"), consecutive)
    cal_mode = cal.select(*scores.columns, "gate", F.lit("calibrated_fresh").alias("mode"), fresh.alias("valid"), "threshold")
    out = all_mode.unionByName(fresh_mode).unionByName(cal_mode)
    return out.withColumn("gate", F.col("gate") & F.col("valid"))


def self_calibrate(
    scores: DataFrame, start: float = 15.0, stop: float = 25.0, detect: float = 30.0, threshold: float = 3.0, consecutive: int = 3,
    min_windows: int = 8, drop_uncalibrated: bool = False,
) -> DataFrame:
    """Median and absolute deviation of an early stretch of the same run scale its later scores.

    A run with fewer than `min_windows` calibration windows fails the job; with `drop_uncalibrated` a run
    without any has no rows instead.
    """
    scores = stage(scores)
    cal = scores.filter((F.col("t") >= start) & (F.col("t") < stop))
    cuts = value_cuts(cal, "score")
    med = quantiles(cal, ["run"], "score", {"median": (0.5, "linear")}, cuts)
    med = med.withColumn("median", require(F.col("n") >= min_windows, "median", "too few calibration windows"))
    dev = cal.join(med.select("run", "median"), "run").withColumn("_dev", F.abs(F.col("score") - F.col("median")))
    mad = quantiles(dev, ["run"], "_dev", {"mad": (0.5, "linear")}, cuts)
    scale = F.greatest(1.4826 * F.col("mad"), 0.05 * F.abs("median"), F.lit(0.05))
    cals = med.join(mad.drop("n"), "run").select("run", "median", scale.alias("scale"))
    late = scores.filter(F.col("t") >= detect)
    late = late.join(cals, "run") if drop_uncalibrated else _calibrated(late, cals, ["run"], "scale")
    z = late.withColumn("z", F.greatest(F.lit(0.0), (F.col("score") - F.col("median")) / F.col("scale")))
    return sustained_gate(z, F.lit(threshold), consecutive, value="z")

