"""Sample-level projections, filters and run inventories (telemetry long table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import is_finite, ratio, require

VALUE_LIMIT = 1e12
MAX_RUN_SECONDS = 7200.0
MIN_RUN_SECONDS = 5.0
MIN_CHANNELS = 8


def select_channels(tel: DataFrame, catalogue: DataFrame, on: Sequence[str] = ("topic", "field")) -> DataFrame:
    """Keep catalogued channels, and of every (run, topic) only the first instance."""
    kept = tel.join(catalogue, list(on), "left_semi")
    if "instance" not in tel.columns:
        return kept
    first = kept.groupBy("run", "topic").agg(F.min("instance").alias("instance"))
    return kept.join(first, ["run", "topic", "instance"], "left_semi")


def valid_samples(tel: DataFrame, limit: float = VALUE_LIMIT) -> DataFrame:
    return tel.filter(F.col("ts_us").isNotNull() & is_finite("value") & (F.abs("value") <= limit))


def dedupe_ts(tel: DataFrame, by: Sequence[str] = ("run", "channel")) -> DataFrame:
    """One sample per timestamp: the one with the lowest arrival number."""
    return tel.groupBy(*by, "ts_us").agg(F.min_by("value", "seq").alias("value"))


def admissible_channels(tel: DataFrame, by: Sequence[str] = ("run", "channel"), min_std: float = 1e-10) -> DataFrame:
    """Channels of a run with two distinct timestamps and a sample deviation above `min_std`."""
    stats = tel.groupBy(*by).agg(
        F.count_distinct("ts_us").alias("distinct_ts"), F.stddev_samp("value").alias("std")
    )
    return stats.filter((F.col("distinct_ts") >= 2) & (F.col("std") > min_std))


def run_status(present: Column, start_us: Column, stop_us: Column, channels: Column, failed: Column | None = None,
               min_s: float = MIN_RUN_SECONDS, max_s: float = MAX_RUN_SECONDS, min_channels: int = MIN_CHANNELS) -> Column:
    """First failing admission test of a run, in fixed order."""
    duration = (stop_us - start_us) / F.lit(1e6)
    n = F.coalesce(channels, F.lit(0))
    ladder = F.when(~present, "missing")
    if failed is not None:
        ladder = ladder.when(failed, "parse_error")
    return (
        ladder.when(stop_us <= start_us, "invalid_time_range")
        .when(duration < min_s, "too_short")
        .when(duration > max_s, "too_long_or_corrupt")
        .when(n == 0, "no_features")
        .when(n < min_channels, "too_few_features")
        .otherwise("usable")
    )


def classify_runs(bounds: DataFrame, channel_counts: DataFrame, **limits) -> DataFrame:
    """`bounds(run, present, start_us, stop_us)` and `channel_counts(run, channels)` -> status per run."""
    joined = bounds.join(channel_counts, "run", "left")
    failed = F.col("failed") if "failed" in joined.columns else None
    status = run_status(F.col("present"), F.col("start_us"), F.col("stop_us"), F.col("channels"), failed, **limits)
    return joined.withColumn("status", status)


def require_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail the job on a missing or non-finite value instead of treating it as normal."""
    return df.withColumns(
        {
            c: F.when(is_finite(c), F.col(c)).otherwise(F.raise_error(F.lit(f"non-finite value in {c}")))
            for c in cols
        }
    )


def require_shape(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """The frame itself; fails when some group does not have exactly `rows` rows."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ok = require(F.col("_n") == rows, F.lit(True), f"{', '.join(by)} without exactly {rows} rows")
    return df.join(counts.withColumn("_ok", ok).filter("_ok").select(*by), list(by), "left_semi")


def require_increasing(df: DataFrame, by: Sequence[str], time: str = "ts_us") -> DataFrame:
    """The frame itself; fails on a time that is missing or occurs twice in a group.

    Rows of a table have no order of their own, so distinct times are what increasing times mean.
    """
    at = [*by, time]
    counts = df.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    ok = require((F.col("_n") == 1) & F.col(time).isNotNull(), F.lit(True), f"{time} does not increase")
    return df.join(counts.withColumn("_ok", ok).filter("_ok").select(*at), at, "left_semi")


def channel_coverage(admissible: DataFrame, usable_runs: DataFrame, core: float = 0.60) -> DataFrame:
    """Share of usable runs that carry a channel, and whether it belongs to the core set."""
    total = usable_runs.select(F.count(F.lit(1)))
    counted = (
        admissible.join(usable_runs.select("run"), "run", "left_semi")
        .groupBy("channel")
        .agg(F.count_distinct("run").alias("runs"))
    )
    covered = counted.withColumn("coverage", ratio(F.col("runs"), total.scalar()))
    return covered.withColumn("core", F.col("coverage") >= core)


def corpus_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum((F.col("stop_us") - F.col("start_us")) / F.lit(1e6)).alias("duration_s"),
        F.sum("rows").alias("rows"),
    )


def check_expected(summary: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Compare counts with an expectation table; rows missing on either side do not match."""
    want = expected.select(*keys, F.col(value).alias("expected"))
    got = summary.select(*keys, F.col(value).alias("actual"))
    return got.join(want, list(keys), "full").withColumn(
        "matches", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    )


def topic_coverage(tel: DataFrame, by: Sequence[str] = ("run", "topic")) -> DataFrame:
    """Samples, valid samples and first/last second per topic, relative to the run's first sample."""
    origin = tel.groupBy("run").agg(F.min("ts_us").alias("origin_us"))
    ok = is_finite("value") & (F.abs("value") <= VALUE_LIMIT)
    stats = tel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count(F.when(ok, 1)).alias("valid_samples"),
        F.min("ts_us").alias("_first"),
        F.max("ts_us").alias("_last"),
    )
    return (
        stats.join(origin, "run")
        .withColumn("first_s", (F.col("_first") - F.col("origin_us")) / 1e6)
        .withColumn("last_s", (F.col("_last") - F.col("origin_us")) / 1e6)
        .drop("_first", "_last", "origin_us")
    )


def missing_channels(tel: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Catalogued channels a run does not carry, as one sorted list (bounded by the catalogue)."""
    wanted = F.array(*[F.lit(c) for c in sorted(channels)])
    seen = tel.filter(F.col("channel").isin(*channels)).groupBy("run").agg(F.collect_set("channel").alias("seen"))
    absent = F.array_except(wanted, F.col("seen"))
    return seen.select(
        "run", F.array_join(absent, "|").alias("missing"), F.size(absent).cast("long").alias("missing_count")
    )


def norm_validity(vectors: DataFrame, by: Sequence[str], vector: str, low: float = 0.95, high: float = 1.05) -> DataFrame:
    """Share of vectors that are finite and have a norm strictly inside (low, high)."""
    x = F.col(vector)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    finite = F.forall(x, lambda v: is_finite(v))
    good = finite & (norm > low) & (norm < high)
    return vectors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("vectors"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("valid_fraction")
    )
