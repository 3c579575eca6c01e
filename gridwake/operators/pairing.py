"""Target and reference streams: as-of interpolation, shared packets, clocks and pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import floor_div, is_finite, lerp, require
from gridwake.functions.text import pair_key
from gridwake.plans.ordered import nearest_points, with_time_chunk
from gridwake.plans.quantiles import quantiles
from gridwake.session import stage


def interp_join(
    target: DataFrame, reference: DataFrame, keys: Sequence[str], chunk_us: int, support: DataFrame | None = None,
    support_keys: Sequence[str] = (),
) -> DataFrame:
    """Target rows with the reference value interpolated at their time (`matched`).

    Only times inside the reference's span, and not after `target_end` or `reference_end` of
    the support table, are kept; nothing is extrapolated.
    """
    keys = list(keys)
    both = (
        target.withColumn("_tgt", F.lit(True))
        .unionByName(reference.select(*keys, "ts_us", F.col("value").alias("_rv")), allowMissingColumns=True)
        .withColumn("_tgt", F.coalesce("_tgt", F.lit(False)))
    )
    both = with_time_chunk(both, keys, "ts_us", chunk_us)
    point = {"ts_us": F.col("ts_us"), "value": F.col("_rv")}
    near = nearest_points(both, keys, "_chunk", ["ts_us", "_tgt"], point, ~F.col("_tgt"))
    hit = near.filter(F.col("_tgt") & (F.col("ts_us") >= F.col("first.ts_us")) & (F.col("ts_us") <= F.col("last.ts_us")))
    value = lerp("ts_us", "prev.ts_us", "prev.value", "next.ts_us", "next.value")
    hit = hit.withColumn("matched", F.when(F.col("next").isNull(), F.col("prev.value")).otherwise(value))
    hit = hit.select(*target.columns, "matched")
    if support is None:
        return hit
    bounded = hit.join(support, list(support_keys))
    return bounded.filter(
        (F.col("ts_us") <= F.col("target_end")) & (F.col("ts_us") <= F.col("reference_end"))
    ).drop("target_end", "reference_end")


#: Reference rows that one task holds of a series at a time.
REFERENCE_BLOCK = 1 << 12


def interp_grid(
    target: DataFrame, reference: DataFrame, keys: Sequence[str], step: int, spans: DataFrame, support_keys: Sequence[str]
) -> DataFrame:
    """`interp_join` of two uniform grids of one step; row `w` of the reference lies `w * step` after its first.

    The rows around a target follow from its time, so each target meets them as neighbours in a block of the
    reference.  `spans` adds to the support the times of the reference's first and last row, `first_us` and `last_us`.
    """
    keys = list(keys)
    upto = F.least("last_us", "target_end", "reference_end")
    inside = target.join(spans, list(support_keys)).filter((F.col("ts_us") >= F.col("first_us")) & (F.col("ts_us") <= upto))
    at = floor_div(F.col("ts_us") - F.col("first_us"), step)
    wanted = inside.select(*target.columns, at.alias("_m"), F.lit(True).alias("_tgt"), (F.col("ts_us") == F.col("last_us")).alias("_end"))
    wanted = wanted.withColumn("_blk", floor_div("_m", REFERENCE_BLOCK))
    point = F.struct("ts_us", "value").alias("_r")
    rows = reference.select(*keys, F.col("w").alias("_m"), point, F.lit(False).alias("_tgt"))
    own = floor_div("_m", REFERENCE_BLOCK)
    # the first row of a block also ends the block before it
    blocks = F.when(F.col("_m") % REFERENCE_BLOCK == 0, F.array(own, own - 1)).otherwise(F.array(own))
    both = wanted.unionByName(rows.withColumn("_blk", F.explode(blocks)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_blk").orderBy("_m", "_tgt")
    near = both.withColumns({"prev": F.lag("_r").over(order), "next": F.lead("_r").over(order)}).filter("_tgt")
    value = lerp("ts_us", "prev.ts_us", "prev.value", "next.ts_us", "next.value")
    value = F.when(F.col("next").isNull(), F.col("prev.value")).otherwise(value)
    met = F.col("prev").isNotNull() & (F.col("next").isNotNull() | F.col("_end"))
    return near.select(*target.columns, require(met, value, "series are not on grids of one step").alias("matched"))


#: Grid positions of a pair that one row of samples covers.
PAIR_BLOCK = 1 << 9


def pair_spans(spans: DataFrame, step: int) -> DataFrame:
    """`spans` with the target's first and last grid position inside the reference and the support, `lo` and `hi`.

    `spans` has per pair the start and the number of grid rows of both sides (`target_start`, `target_rows`,
    `reference_start`, `reference_rows`) and the support's `target_end` and `reference_end`.  `shift` is the
    reference's position at or before position 0 of the target; `windows` is 0 for a pair without overlap.
    """
    apart = F.col("reference_start") - F.col("target_start")
    last = F.col("reference_start") + (F.col("reference_rows") - 1) * step
    upto = F.least(last, F.col("target_end"), F.col("reference_end"))
    lo = F.greatest(F.lit(0), F.ceil(apart / F.lit(step))).cast("long")
    hi = F.least(F.col("target_rows") - 1, F.floor((upto - F.col("target_start")) / F.lit(step))).cast("long")
    both = F.col("target_start").isNotNull() & F.col("reference_start").isNotNull()
    out = spans.withColumns({"lo": F.when(both, lo), "hi": F.when(both, hi), "shift": floor_div(-apart, step)})
    return out.withColumn("windows", F.when(both, F.greatest(F.lit(0), F.col("hi") - F.col("lo") + 1)).otherwise(0).cast("long"))


def enough_windows(spans: DataFrame, min_windows: int = 3) -> DataFrame:
    """Pairs that overlap; one with fewer than `min_windows` windows fails the job."""
    return spans.filter("windows > 0").withColumn("lo", require(F.col("windows") >= min_windows, "lo", "too few common windows"))


def _pair_cells(samples: DataFrame, spans: DataFrame, step: int) -> DataFrame:
    """First and last sample of every series after one position of the target's grid and up to the next, `p`.

    No other sample decides a value on the grid, so dense stretches shrink before they are sorted.
    """
    placed = samples.join(spans.select("run", "target_start", "reference_start", "shift"), "run")
    own = F.col("side") == 0
    at = F.ceil((F.col("ts_us") - F.when(own, F.col("target_start")).otherwise(F.col("reference_start"))) / F.lit(step)).cast("long")
    placed = placed.withColumn("p", at - F.when(own, F.lit(0)).otherwise(F.col("shift")))
    return placed.groupBy("run", "side", "feature", "p").agg(
        F.min("ts_us").alias("t0"), F.min_by("value", "ts_us").alias("v0"), F.max("ts_us").alias("t1"), F.max_by("value", "ts_us").alias("v1")
    )


def _pair_edges(cells: DataFrame, spans: DataFrame, items: Sequence[str], block: int) -> DataFrame:
    """For every series and wanted block, as cells, the last sample before it and the first one behind it.

    A block also holds the first position of the next one.  `enough` tells a series of two samples or more.
    """
    wanted = spans.withColumn("_blk", F.explode(F.sequence(floor_div("lo", block), floor_div("hi", block))))
    wanted = wanted.select("run", "_blk", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    wanted = wanted.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in items])))
    later = F.when(F.col("p") % block != 0, F.col("t0"))
    held = cells.withColumn("_blk", floor_div("p", block)).unionByName(wanted.withColumn("_want", F.lit(True)), allowMissingColumns=True)
    ends = held.groupBy("run", "side", "feature", "_blk").agg(
        F.min("t0").alias("t0"), F.min_by("v0", "t0").alias("v0"), F.min(later).alias("t2"), F.min_by("v0", later).alias("v2"),
        F.max("t1").alias("t1"), F.max_by("v1", "t1").alias("v1"), F.max("_want").alias("_want"),
    )

    def point(t: str, v: str):
        return F.when(F.col(t).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))

    series = Window.partitionBy("run", "side", "feature")
    back, upto = series.orderBy(F.col("_blk").desc()), Window.unboundedPreceding
    near = ends.select(
        "run", "side", "feature", "_blk", "_want",
        F.last(point("t1", "v1"), ignorenulls=True).over(series.orderBy("_blk").rowsBetween(upto, -1)).alias("_cp"),
        F.coalesce(F.last(point("t2", "v2"), ignorenulls=True).over(back.rangeBetween(-1, -1)), F.last(point("t0", "v0"), ignorenulls=True).over(back.rangeBetween(upto, -2))).alias("_cn"),
        (F.min("t0").over(series) < F.max("t1").over(series)).alias("enough"),
    ).filter("_want")
    first = F.col("_blk") * block
    both = F.array(F.struct((first - 1).alias("p"), F.col("_cp").alias("e")), F.struct((first + block + 1).alias("p"), F.col("_cn").alias("e")))
    spread = near.select("run", "side", "feature", "_blk", F.coalesce("enough", F.lit(False)).alias("enough"), F.explode(both).alias("_e"))
    time, value = F.col("_e.e.t"), F.col("_e.e.v")
    return spread.select("run", "side", "feature", "_blk", "enough", F.col("_e.p").alias("p"), time.alias("t0"), value.alias("v0"), time.alias("t1"), value.alias("v1"))


def _on_grid(keys, cells, rows, side, pos, times, width):
    """Values of the series of `rows` and `side` at positions `pos`, which lie at `times`; clamped at the ends."""
    t0, v0, t1, v1 = cells
    group = rows * 2 + side
    before = np.searchsorted(keys, group * width + pos, "right") - 1
    after = np.minimum(before + 1, len(keys) - 1)
    has_before = (before >= 0) & (keys[before] // width == group)
    has_after = (before + 1 < len(keys)) & (keys[after] // width == group)
    ta, va, tb, vb = t1[before], v1[before], t0[after], v0[after]
    inner = va + (vb - va) * ((times - ta).astype(float) / np.maximum(tb - ta, 1))
    return np.where(has_before & has_after, inner, np.where(has_before, va, np.where(has_after, vb, 0.0)))


def _pair_values(step: int, block: int):
    """Arrow UDF: cells of a pair's feature in a block -> target and matched reference of every wanted position."""

    @F.arrow_udf("array<struct<value:double,matched:double>>")
    def run(cells: pa.Array, enough: pa.Array, blk: pa.Array, lo: pa.Array, hi: pa.Array, start: pa.Array, reference: pa.Array, shift: pa.Array) -> pa.Array:
        blk, lo, hi, start, reference, shift = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (blk, lo, hi, start, reference, shift))
        owner = np.repeat(np.arange(len(blk)), np.diff(cells.offsets.to_numpy().astype(np.int64)))
        flat = cells.flatten()
        side, p, t0, v0, t1, v1 = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
        width = block + 3
        keys = (owner * 2 + side) * width + (p - blk[owner] * block + 1)
        order = np.argsort(keys)
        keys, held = keys[order], (t0[order], v0[order], t1[order], v1[order])
        counts = hi - lo + 1
        ends = np.cumsum(counts)
        rows = np.repeat(np.arange(len(blk)), counts)
        w = lo[rows] + np.arange(len(rows)) - (ends - counts)[rows]
        pos, at = w - blk[rows] * block + 1, start[rows] + w * step
        below = reference[rows] + (w + shift[rows]) * step
        if len(keys):
            value = _on_grid(keys, held, rows, 0, pos, at, width)
            a = _on_grid(keys, held, rows, 1, pos, below, width)
            b = _on_grid(keys, held, rows, 1, pos + 1, below + step, width)
        else:
            value = a = b = np.zeros(len(rows))
        ok = enough.flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, 2)
        value = np.where(ok[rows, 0], value, 0.0)
        matched = np.where(ok[rows, 1], a + (b - a) * ((at - below).astype(float) / step), 0.0)
        made = pa.StructArray.from_arrays([pa.array(value), pa.array(matched)], ["value", "matched"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), made)

    return run


def interp_samples(samples: DataFrame, spans: DataFrame, items: Sequence[str], step: int) -> DataFrame:
    """`interp_grid` straight from the samples: `(run, w, feature, value, matched)` of the pairs in `spans`.

    `samples(run, side, feature, ts_us, value)` have one value a time, side 0 is the target.  Both sides lie on a
    uniform grid from their start on, resampled as `resample_linear(..., zero_empty=True)` does.  Grid rows
    are made only where a pair is compared, block by block, so neither grid is written, shuffled or sorted.
    """
    block = PAIR_BLOCK
    cells = _pair_cells(samples.filter(F.col("feature").isin(*items)), spans, step)
    own = floor_div("p", block)
    # the first position of a block also ends the block before it
    homes = F.when(F.col("p") % block == 0, F.array(own, own - 1)).otherwise(F.array(own))
    held = cells.withColumn("_blk", F.explode(homes)).unionByName(_pair_edges(cells, spans, items, block), allowMissingColumns=True)
    cell = F.when(F.col("t0").isNotNull(), F.struct(F.col("side").cast("long").alias("side"), "p", "t0", "v0", "t1", "v1"))
    both = F.array(*[F.coalesce(F.max(F.when(F.col("side") == k, F.col("enough"))), F.lit(False)) for k in (0, 1)])
    # all features of a pair's block stay together: what follows adds them up per window
    grouped = held.repartition("run", "_blk").groupBy("run", "_blk", "feature").agg(F.collect_list(cell).alias("_c"), both.alias("_ok"))
    first = F.col("_blk") * block
    sized = grouped.join(spans.select("run", "lo", "hi", "shift", "target_start", "reference_start"), "run")
    sized = sized.withColumns({"lo": F.greatest("lo", first), "hi": F.least("hi", first + block - 1)}).filter("lo <= hi")
    pairs = _pair_values(step, block)("_c", "_ok", "_blk", "lo", "hi", "target_start", "reference_start", "shift")
    made = sized.select("run", "feature", "lo", pairs.alias("_v")).select("run", "feature", "lo", F.posexplode("_v").alias("_i", "_v"))
    return made.select("run", (F.col("lo") + F.col("_i")).alias("w"), "feature", "_v.value", "_v.matched")


def grid_residual_rows(
    target: DataFrame, reference: DataFrame, keys: Sequence[str], step: int, spans: DataFrame, support_keys: Sequence[str],
    digits: int | None = None,
) -> DataFrame:
    """`residual_rows` with a reference on a uniform grid."""
    return _residuals(interp_grid(target, reference, keys, step, spans, support_keys), digits)


def sample_residual_rows(samples: DataFrame, spans: DataFrame, items: Sequence[str], step: int, digits: int | None = None) -> DataFrame:
    """`grid_residual_rows` straight from the samples."""
    return _residuals(interp_samples(samples, spans, items, step), digits)


def _residuals(joined: DataFrame, digits: int | None) -> DataFrame:
    res = F.abs(F.col("value") - F.col("matched"))
    return joined.withColumn("residual", res if digits is None else F.round(res, digits)).drop("matched")


def residual_rows(
    target: DataFrame, reference: DataFrame, keys: Sequence[str], chunk_us: int, support: DataFrame | None = None,
    support_keys: Sequence[str] = (), digits: int | None = None,
) -> DataFrame:
    """|target - interpolated reference| wherever the pair has both."""
    return _residuals(interp_join(target, reference, keys, chunk_us, support, support_keys), digits)


def window_counts(residuals: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`(keys, windows)` of every pair in `pairs`: its common windows, 0 for a pair that never overlaps."""
    keys = list(keys)
    counts = residuals.groupBy(*keys).agg(F.count_distinct("w").alias("_nw"))
    return pairs.select(*keys).distinct().join(counts, keys, "left").select(*keys, F.coalesce("_nw", F.lit(0)).cast("long").alias("windows"))


def require_windows(residuals: DataFrame, counts: DataFrame, keys: Sequence[str], min_windows: int = 3) -> DataFrame:
    """Residuals of the pairs in `counts`; a pair with fewer than `min_windows` windows fails the job."""
    enough = require(F.col("windows") >= min_windows, "windows", "too few common windows")
    return counts.withColumn("windows", enough).filter("windows >= 0").join(residuals, list(keys)).select(*residuals.columns)


def matched_residual(
    target: DataFrame, reference: DataFrame, keys: Sequence[str], chunk_us: int, support: DataFrame | None = None,
    support_keys: Sequence[str] = (), min_windows: int = 3, digits: int | None = None,
) -> DataFrame:
    """`residual_rows`; with `support_keys`, a pair with fewer than `min_windows` windows fails the job, one without any overlap included."""
    rows = residual_rows(target, reference, keys, chunk_us, support, support_keys, digits)
    if not support_keys:
        return rows
    rows = stage(rows)
    return require_windows(rows, window_counts(rows, target if support is None else support, support_keys), support_keys, min_windows)


def shared_packets(a: DataFrame, b: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """Rows of both streams (`side` a/b); topics whose common timestamps reach `least` of the
    shorter stream (and at least two) keep only the common packets, others keep all."""
    keys = list(keys)
    common = a.select(*keys, "ts_us").intersect(b.select(*keys, "ts_us")).withColumn("_common", F.lit(True))
    na = a.groupBy(*keys).agg(F.count_distinct("ts_us").alias("_na"))
    nb = b.groupBy(*keys).agg(F.count_distinct("ts_us").alias("_nb"))
    nc = common.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc"))
    stats = na.join(nb, keys, "full").join(nc, keys, "left")
    n = F.least(F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0)))
    frac = F.coalesce("_nc", F.lit(0)) / F.greatest(F.lit(1), n)
    stats = stats.select(
        *keys, frac.alias("shared_fraction"), ((frac >= least) & (F.coalesce("_nc", F.lit(0)) >= 2)).alias("shared")
    )
    rows = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    tagged = rows.join(common, [*keys, "ts_us"], "left").join(stats, keys)
    return tagged.filter(~F.col("shared") | F.col("_common")).drop("_common")


def parity_audit(a: DataFrame, b: DataFrame, keys: Sequence[str], chunk_us: int) -> DataFrame:
    """Common timestamps, share of exactly equal values, largest difference and largest gap of both sides."""
    from gridwake.operators.grid import sample_gaps

    keys = list(keys)
    j = a.select(*keys, "ts_us", F.col("value").alias("_a")).join(b.select(*keys, "ts_us", F.col("value").alias("_b")), [*keys, "ts_us"])
    diff = F.abs(F.col("_a") - F.col("_b"))
    eq = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("common"), F.avg(F.when(diff == 0, 1.0).otherwise(0.0)).alias("exact_fraction"), F.max(diff).alias("max_delta")
    )
    out = None
    for side, df in (("a", a), ("b", b)):
        gaps = sample_gaps(df, chunk_us, keys).groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{side}_samples"), (F.max("gap_us") / 1000.0).alias(f"{side}_max_gap_ms")
        )
        out = gaps if out is None else out.join(gaps, keys, "full")
    return out.join(eq, keys, "left").withColumn("common", F.coalesce("common", F.lit(0)).cast("long"))


def clock_offset(
    source: DataFrame, replay: DataFrame, origins: DataFrame, payload: Sequence[str], by: Sequence[str] = ("run",),
    anchors: int | None = None, min_matches: int = 8, tolerance_us: int = 1000,
) -> DataFrame:
    """Clock origin of a replay, from payloads that occur once in the source.

    Every replay sample counts, or only the first `anchors` of a run.  The offset is the truncated
    median of the matched time differences; too few matches, a deviation above the tolerance or a
    negative origin fails the job.
    """
    by = list(by)
    key = F.concat_ws("|", *[F.col(c).cast("float").cast("string") for c in payload])
    finite = F.lit(True)
    for c in payload:
        finite = finite & is_finite(F.col(c).cast("float"))
    unique = (
        source.withColumn("_key", key).groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_src")).filter("_n = 1")
    )
    if anchors is not None:
        w = Window.partitionBy(*by).orderBy("ts_us", "seq")
        replay = replay.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= anchors)
    matched = replay.withColumn("_key", key).filter(finite).join(unique, [*by, "_key"])
    offsets = matched.select(*by, (F.col("ts_us") - F.col("_src")).alias("_off"))
    offsets = stage(offsets)
    median = quantiles(offsets, by, "_off", {"_mid": (0.5, "linear")}).select(*by, F.col("n").alias("matches"), F.col("_mid").cast("long").alias("offset_us"))
    stats = median.join(offsets.groupBy(*by).agg(F.min("_off").alias("_lo"), F.max("_off").alias("_hi")), by)
    dev = F.greatest(F.abs(F.col("_lo") - F.col("offset_us")), F.abs(F.col("_hi") - F.col("offset_us")))
    origin = F.col("origin_us") + F.col("offset_us")
    j = origins.join(stats, by, "left")
    ok_n = F.coalesce(F.col("matches"), F.lit(0)) >= min_matches
    checked = F.when(~ok_n, F.raise_error(F.lit("insufficient unique clock anchors")).cast("long")).when(
        dev > tolerance_us, F.raise_error(F.lit("replay clock is not a constant offset")).cast("long")
    ).when(origin < 0, F.raise_error(F.lit("negative replay origin")).cast("long")).otherwise(origin)
    return j.select(*by, "matches", "offset_us", dev.alias("max_deviation_us"), checked.alias("origin_us"))


def pair_runs(manifest: DataFrame, reference: str = "baseline", run_id: str = "run_id") -> DataFrame:
    """Targets joined to the reference run with the same pair key; equal content hashes fail the job."""
    keyed = manifest.withColumn("pair_key", pair_key(run_id))
    ref = (
        keyed.filter(F.col("condition") == reference)
        .groupBy("pair_key")
        .agg(F.min(F.struct(F.col(run_id).alias("id"), F.col("content_hash").alias("h"))).alias("r"))
        .select("pair_key", F.col("r.id").alias("reference_id"), F.col("r.h").alias("reference_hash"))
    )
    j = keyed.filter(F.col("condition") != reference).join(ref, "pair_key")
    return j.withColumn(
        "reference_hash", require(F.col("content_hash") != F.col("reference_hash"), "reference_hash", "target equals its reference")
    )


def nearest_reference(first: DataFrame, second: DataFrame, scale: DataFrame, keys: Sequence[str], scale_keys: Sequence[str]) -> DataFrame:
    """Smaller of two reference distances over the sides that are valid, divided by the scale.

    Without a valid side or an available scale the distance is 0 and the row is invalid.
    """
    a = first.select(*keys, F.when(F.col("valid"), F.col("distance")).alias("_a"))
    b = second.select(*keys, F.when(F.col("valid"), F.col("distance")).alias("_b"))
    j = a.join(b, list(keys), "full").join(scale.select(*scale_keys, "scale"), list(scale_keys), "left")
    near = F.least("_a", "_b")
    valid = near.isNotNull() & F.col("scale").isNotNull()
    return j.select(
        *keys, F.when(valid, F.try_divide(near, F.col("scale"))).otherwise(F.lit(0.0)).alias("distance"), valid.alias("valid")
    )

