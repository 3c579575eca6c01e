"""Time bounds, uniform grids, resampling, filling and interval labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import floor_div, lerp
from gridwake.plans.ordered import nearest_points, with_time_chunk
from gridwake.plans.panes import explode_range
from gridwake.plans.quantiles import quantiles
from gridwake.session import stage

UNKNOWN_CLASS = 5
GRID_BLOCK = 4096
#: Time of the row that closes a series, after any sample.
CLOSE_US = 1 << 62


def time_bounds(runs: DataFrame, tel: DataFrame, keep_start: bool = False, max_s: float = 7200.0) -> DataFrame:
    """Header bounds when sane, else the bounds of the valid topic timestamps; neither is an error."""
    seen = tel.filter("ts_us >= 0").groupBy("run").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    limit = int(max_s * 1e6)
    joined = runs.join(seen, "run", "left")
    head_ok = (F.col("header_stop") > F.col("header_start")) & (F.col("header_stop") - F.col("header_start") <= limit)
    lo = F.col("lo")
    if keep_start:
        keep = (
            (F.col("header_start") >= 0)
            & (F.col("header_start") < F.col("hi"))
            & (F.col("hi") - F.col("header_start") <= limit)
        )
        lo = F.when(keep, F.col("header_start")).otherwise(lo)
    head_ok = F.coalesce(head_ok, F.lit(False))
    derived_ok = F.coalesce((F.col("hi") > lo) & (F.col("hi") - lo <= limit), F.lit(False))
    bad = F.raise_error(F.lit("invalid or excessive time range")).cast("long")
    return joined.select(
        "run",
        F.when(head_ok, F.col("header_start")).when(derived_ok, lo).otherwise(bad).alias("start_us"),
        F.when(head_ok, F.col("header_stop")).when(derived_ok, F.col("hi")).otherwise(bad).alias("stop_us"),
    )


def grid_rows(start: Column, stop: Column, step: int) -> Column:
    return (F.floor((stop - start) / F.lit(step)) + 1).cast("long")


def make_grid(bounds: DataFrame, step: int, origin: str | None = None) -> DataFrame:
    """Grid points `(run, k, ts_us, rows)`; rows are made block by block, never as one array."""
    start = F.col("start_us")
    if origin is not None:
        o = F.col(origin)
        start = F.when((o >= 0) & (o < F.col("stop_us")), o).otherwise(
            F.raise_error(F.lit("grid origin outside the run")).cast("long")
        )
    sized = bounds.withColumn("start_us", start).withColumn(
        "rows", grid_rows(F.col("start_us"), F.col("stop_us"), step)
    )
    points = explode_range(sized, "rows", "k")
    return points.withColumn("ts_us", F.col("start_us") + F.col("k") * step)


def span_bounds(tel: DataFrame, mode: str = "union", keep_empty: bool = False) -> DataFrame:
    """Bounds of a multi-channel run: union of the channel spans, or their overlap.

    An empty overlap is an error; with `keep_empty` such a run stays, its stop at or before its start.
    """
    per = tel.groupBy("run", "channel").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    if mode == "union":
        return per.groupBy("run").agg(F.min("a").alias("start_us"), F.max("b").alias("stop_us"))
    both = per.groupBy("run").agg(F.max("a").alias("start_us"), F.min("b").alias("stop_us"))
    if keep_empty:
        return both
    return both.withColumn(
        "stop_us",
        F.when(F.col("stop_us") > F.col("start_us"), F.col("stop_us")).otherwise(
            F.raise_error(F.lit("channels share no time span")).cast("long")
        ),
    )


@dataclass(frozen=True)
class Uniform:
    """The grid of `make_grid(bounds, step)`, not yet made."""

    bounds: DataFrame
    step: int


def _around(
    tel: DataFrame, grid: DataFrame | Uniform, channels: Sequence[str], chunk_us: int, extra: Mapping[str, Column]
) -> DataFrame:
    """Grid rows of every channel with the samples before and after them."""
    samples = tel.select("run", "channel", "ts_us", "value", *[e.alias(n) for n, e in extra.items()])
    point = {n: F.col(n) for n in ("ts_us", "value", *extra)}
    if isinstance(grid, Uniform):
        return _between(samples, grid, channels, chunk_us, point)
    targets = grid.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    points = targets.select("run", "channel", "ts_us", "k", "rows").unionByName(samples, allowMissingColumns=True)
    points = points.withColumn("_grid", F.col("k").isNotNull())
    points = with_time_chunk(points, ["run", "channel"], "ts_us", chunk_us)
    near = nearest_points(points, ["run", "channel"], "_chunk", ["ts_us", "_grid"], point, ~F.col("_grid"))
    return near.filter("_grid").drop("value", "_grid", "_chunk", *extra)


def _between(samples: DataFrame, grid: Uniform, channels: Sequence[str], chunk_us: int, point: Mapping[str, Column]) -> DataFrame:
    """The same on a uniform grid: every sample makes the grid rows since the sample before it.

    So only samples are sorted and scanned.  A closing row per series makes the rows behind its last sample,
    or all of an empty one.  The rows of a long gap are made by many tasks, in blocks.
    """
    step = F.lit(grid.step)
    sized = grid.bounds.select("run", F.col("start_us").alias("_o"), grid_rows(F.col("start_us"), F.col("stop_us"), grid.step).alias("rows"))
    close = sized.select("run", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"), F.lit(CLOSE_US).alias("ts_us"))
    both = samples.filter(F.col("channel").isin(*channels)).unionByName(close, allowMissingColumns=True)
    both = with_time_chunk(both, ["run", "channel"], "ts_us", chunk_us)
    closing = F.col("ts_us") == CLOSE_US
    seen = nearest_points(both, ["run", "channel"], "_chunk", ["ts_us"], point, ~closing, strict=True, need="prev")
    gaps = seen.withColumn("next", F.when(~closing, F.struct(*[e.alias(n) for n, e in point.items()]))).join(sized, "run")
    lo = F.greatest(F.lit(0), F.ceil((F.col("prev.ts_us") - F.col("_o")) / step)).cast("long")
    hi = F.least(F.col("rows"), F.ceil((F.col("next.ts_us") - F.col("_o")) / step)).cast("long") - 1
    gaps = gaps.select("run", "channel", "rows", "_o", "prev", "next", "points", "first", "last", lo.alias("_lo"), hi.alias("_hi"))
    gaps = gaps.filter("_lo <= _hi").withColumn("_b", F.explode(F.sequence(floor_div("_lo", GRID_BLOCK), floor_div("_hi", GRID_BLOCK))))
    own = F.sequence(F.greatest(F.col("_lo"), F.col("_b") * GRID_BLOCK), F.least(F.col("_hi"), F.col("_b") * GRID_BLOCK + GRID_BLOCK - 1))
    made = gaps.repartition("run", "channel", "_b").withColumn("k", F.explode(own))
    return made.withColumn("ts_us", F.col("_o") + F.col("k") * step).drop("_o", "_lo", "_hi", "_b")


def resample_linear(
    tel: DataFrame, grid: DataFrame | Uniform, channels: Sequence[str], chunk_us: int, single: str = "null", zero_empty: bool = False
) -> DataFrame:
    """Linear resampling with clamped edges.

    A series with one point is NULL, or constant with `single="const"`; an empty one is NULL.
    Edges are clamped, so a series is NULL as a whole or not at all; `zero_empty` turns such
    series into zeros and spares a separate fill.
    """
    near = _around(tel, grid, channels, chunk_us, {})
    value = lerp("ts_us", "prev.ts_us", "prev.value", "next.ts_us", "next.value")
    value = F.when(F.col("prev").isNull(), F.col("next.value")).when(F.col("next").isNull(), F.col("prev.value")).otherwise(value)
    if single == "null":
        value = F.when(F.col("points") >= 2, value)
    if zero_empty:
        value = F.coalesce(value, F.lit(0.0))
    return near.select("run", "channel", "k", "ts_us", "rows", value.alias("value"))


def sample_gaps(tel: DataFrame, chunk_us: int, by: Sequence[str] = ("run", "channel")) -> DataFrame:
    """Every sample with the distance to the one before it in its series."""
    chunked = with_time_chunk(tel, by, "ts_us", chunk_us)
    near = nearest_points(chunked, by, "_chunk", ["ts_us"], {"ts_us": F.col("ts_us")}, strict=True, need="prev")
    return near.withColumn("gap_us", F.col("ts_us") - F.col("prev.ts_us")).drop("prev", "_chunk", "points", "first", "last")


def resample_supported(
    tel: DataFrame, grid: DataFrame | Uniform, channels: Sequence[str], chunk_us: int, floor_us: float = 1e5, factor: float = 5.0
) -> DataFrame:
    """Linear values plus `valid`: inside the span and the bracketing gap at most
    `max(floor, factor * median gap)` of the series.  Series with fewer than two points give 0, invalid."""
    gaps = stage(sample_gaps(tel, chunk_us))
    limits = quantiles(gaps.withColumn("gap_us", F.col("gap_us").cast("double")), ["run", "channel"], "gap_us",
                       {"median": (0.5, "linear")})
    limits = limits.select("run", "channel", F.greatest(F.lit(floor_us), F.lit(factor) * F.col("median")).alias("limit_us"))
    near = _around(gaps, grid, channels, chunk_us, {"gap_us": F.col("gap_us")}).join(limits, ["run", "channel"], "left")
    value = lerp("ts_us", "prev.ts_us", "prev.value", "next.ts_us", "next.value")
    value = F.when(F.col("prev").isNull(), F.col("next.value")).when(F.col("next").isNull(), F.col("prev.value")).otherwise(value)
    bracket = F.when(F.col("next").isNotNull(), F.col("next.gap_us")).otherwise(F.col("prev.gap_us"))
    inside = F.col("prev").isNotNull() & (F.col("ts_us") <= F.col("last.ts_us"))
    enough = F.col("points") >= 2
    return near.select(
        "run", "channel", "k", "ts_us", "rows",
        F.coalesce(F.when(enough, value), F.lit(0.0)).alias("value"),
        F.coalesce(enough & inside & (bracket <= F.col("limit_us")), F.lit(False)).alias("valid"),
    )


def fill_series(aligned: DataFrame, block: int = GRID_BLOCK) -> DataFrame:
    """Fill NULLs by row position: edges take the nearest value, gaps are linear, empty series are 0."""
    chunked = aligned.withColumn("_chunk", floor_div("k", block))
    point = {"k": F.col("k"), "value": F.col("value")}
    near = nearest_points(chunked, ["run", "channel"], "_chunk", ["k"], point, F.col("value").isNotNull())
    gap = lerp("k", "prev.k", "prev.value", "next.k", "next.value")
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(
        F.col("prev").isNotNull() & F.col("next").isNotNull(), gap
    ).otherwise(F.coalesce(F.col("next.value"), F.col("prev.value"), F.lit(0.0)))
    return near.withColumn("value", filled).drop("prev", "next", "points", "first", "last", "_chunk")


def _covered(intervals: DataFrame, bounds: DataFrame, step: int, block: int) -> DataFrame:
    """Intervals cut to grid positions and to blocks of the grid: `(run, block, lo, hi, ...)`.

    A block has `block` positions, so after grouping by (lo, hi) it holds at most
    block*(block+1)/2 rows per class however many intervals pile up.
    """
    sized = bounds.select("run", "start_us", grid_rows(F.col("start_us"), F.col("stop_us"), step).alias("rows"))
    j = intervals.join(sized.withColumnRenamed("start_us", "_origin"), "run")
    lo = F.greatest(F.lit(0), F.ceil((F.col("start_us") - F.col("_origin")) / F.lit(step))).cast("long")
    hi = F.least(F.col("rows") - 1, F.floor((F.col("end_us") - F.col("_origin")) / F.lit(step))).cast("long")
    j = j.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    j = j.withColumn("_blk", F.explode(F.sequence(floor_div("_lo", block), floor_div("_hi", block))))
    return j.withColumns(
        {
            "lo": F.greatest(F.col("_lo"), F.col("_blk") * block),
            "hi": F.least(F.col("_hi"), F.col("_blk") * block + block - 1),
        }
    )


def interval_points(intervals: DataFrame, bounds: DataFrame, step: int, block: int = 32) -> DataFrame:
    """Labelled grid positions `(run, k, class_id)`; the last interval in document order wins."""
    cut = _covered(intervals, bounds, step, block)
    winner = F.max(F.struct("ordinal", "class_id")).alias("win")
    merged = cut.groupBy("run", "_blk", "lo", "hi").agg(winner)
    spread = merged.withColumn("k", F.explode(F.sequence("lo", "hi")))
    return spread.groupBy("run", "k").agg(F.max("win").alias("win")).select("run", "k", F.col("win.class_id").alias("class_id"))


def label_points(grid: DataFrame, intervals: DataFrame, bounds: DataFrame, step: int) -> DataFrame:
    """Grid rows with `label` (inside any interval, both ends included) and `class_id` (0 outside)."""
    hits = interval_points(intervals, bounds, step)
    return (
        grid.join(hits, ["run", "k"], "left")
        .withColumn("label", F.col("class_id").isNotNull().cast("long"))
        .withColumn("class_id", F.coalesce("class_id", F.lit(0)).cast("long"))
    )


def class_ids(class_name: Column, ids: Mapping[str, int], unknown: int = UNKNOWN_CLASS) -> Column:
    expr = F.lit(unknown)
    for name, number in ids.items():
        expr = F.when(class_name == name, F.lit(number)).otherwise(expr)
    return expr.cast("long")


def label_points_multi(grid: DataFrame, intervals: DataFrame, bounds: DataFrame, step: int, block: int = 32) -> DataFrame:
    """Grid rows with the sorted distinct classes covering them, joined by `|` (empty when none)."""
    cut = _covered(intervals, bounds, step, block)
    merged = cut.select("run", "class", "_blk", "lo", "hi").distinct()
    points = merged.withColumn("k", F.explode(F.sequence("lo", "hi"))).select("run", "k", "class").distinct()
    named = points.groupBy("run", "k").agg(F.array_join(F.array_sort(F.collect_set("class")), "|").alias("classes"))
    return grid.join(named, ["run", "k"], "left").withColumn("classes", F.coalesce("classes", F.lit("")))


def pool_topics(aligned: DataFrame) -> DataFrame:
    """Mean over the channels of a topic at every grid row."""
    return aligned.groupBy("run", "k", "topic").agg(F.avg("value").alias("value"))


def onset_label(grid: DataFrame, events: DataFrame) -> DataFrame:
    """1 from the first event of the run on, 0 before it or without one."""
    first = events.groupBy("run").agg(F.min("ts_us").alias("onset_us"))
    return grid.join(first, "run", "left").withColumn(
        "label", F.coalesce((F.col("ts_us") >= F.col("onset_us")).cast("long"), F.lit(0).cast("long"))
    )
