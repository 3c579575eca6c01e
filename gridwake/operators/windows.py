"""Sliding windows over aligned runs: labels, majority class, validity, descriptors, scaling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import floor_div
from gridwake.plans.panes import WindowSpec, reduce_to_windows, window_count

# Names and order of the window descriptors.
DESCRIPTORS = (
    "mean", "std", "min", "max", "range", "q10", "q25", "q50", "q75", "q90",
    "start", "end", "endpoint_delta", "diff_mean", "diff_std", "diff_abs_mean", "diff_abs_max", "lag1",
)


def window_label(windows: DataFrame, points: DataFrame, spec: WindowSpec) -> DataFrame:
    """Highest point label over the window and its look-ahead horizon."""
    positive = points.filter("label > 0")
    hit = reduce_to_windows(positive, ["run"], "k", spec.span, spec.stride, {"label": ("label", "max")})
    return windows.join(hit, ["run", "w"], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))


def window_class(windows: DataFrame, points: DataFrame, spec: WindowSpec, classes: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Most frequent class id over the window and horizon; ties take the lowest id, none is 0."""
    counted = points.filter(F.col("class_id").isin(*classes)).withColumn("one", F.lit(1).cast("long"))
    hits = reduce_to_windows(counted, ["run", "class_id"], "k", spec.span, spec.stride, {"n": ("one", "sum")})
    best = hits.groupBy("run", "w").agg(F.max(F.struct("n", -F.col("class_id"))).alias("b"))
    best = best.select("run", "w", (-F.col("b.col2")).alias("class_id"))
    return windows.join(best, ["run", "w"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)).cast("long"))


def decision_time(start_k: Column, spec: WindowSpec) -> Column:
    return (start_k + spec.window) / F.lit(spec.frequency_hz)


def decision_index(start_k: Column, rows: Column, spec: WindowSpec) -> Column:
    return F.least(start_k + spec.window - 1, rows - 1)


def window_validity(windows: DataFrame, supported: DataFrame, spec: WindowSpec, by: Sequence[str] = ("run", "channel")) -> DataFrame:
    """Valid only when every sample of the window is supported; missing samples count as unsupported."""
    ok = supported.withColumn("good", F.col("valid").cast("long"))
    hits = reduce_to_windows(ok, by, "k", spec.window, spec.stride, {"good": ("good", "sum")})
    return windows.join(hits, [*by, "w"], "left").withColumn(
        "valid", F.coalesce(F.col("good"), F.lit(0)) == spec.window
    ).drop("good")


def _sample_blocks(aligned: DataFrame, spec: WindowSpec, windows_per_block: int) -> DataFrame:
    """Samples of `windows_per_block` consecutive windows as one array `_v` per (run, channel).

    A sample travels once to the block of windows it belongs to (twice near a block edge), not
    once per window, and a block array is bounded by the block size.  `_o` is the array offset
    of window `w_lo`, `n` the number of windows.
    """
    per = max(windows_per_block, -(-spec.window // spec.stride))
    first_w = F.greatest(F.lit(0), F.ceil((F.col("k") - spec.window + 1) / F.lit(spec.stride))).cast("long")
    last_w = F.floor(F.col("k") / F.lit(spec.stride)).cast("long")
    last_w = F.least(last_w, window_count("rows", spec) - 1)
    routed = (
        aligned.withColumns({"_fw": first_w, "_lw": last_w})
        .filter("_fw <= _lw")
        .withColumn("_blk", F.explode(F.sequence(floor_div("_fw", per), floor_div("_lw", per))))
    )
    blocks = routed.groupBy("run", "channel", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("k", "value"))).alias("_s"),
        F.max(window_count("rows", spec)).alias("_nw"),
    )
    w_lo = F.col("_blk") * per
    return blocks.select(
        "run", "channel",
        w_lo.alias("w_lo"),
        (F.least(w_lo + per, F.col("_nw")) - w_lo).alias("n"),
        (w_lo * spec.stride - F.col("_s")[0]["k"]).alias("_o"),
        F.col("_s.value").alias("_v"),
    )


def window_samples(aligned: DataFrame, spec: WindowSpec, windows_per_block: int = 64) -> DataFrame:
    """One row per (run, channel, w) with the window's samples as an array `x`."""
    blocks = _sample_blocks(aligned, spec, windows_per_block)
    cut = blocks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    offset = (F.col("_o") + F.col("_i") * spec.stride + 1).cast("int")
    return cut.select(
        "run", "channel", (F.col("w_lo") + F.col("_i")).alias("w"), F.slice("_v", offset, F.lit(spec.window)).alias("x")
    )


class _Running:
    """Moments of stretches of blocks of samples, from running sums that start anew in every block.

    Blocks are rows of a padded matrix, centred on their own means, so that sums stay small.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        blocks, width = len(sizes), int(sizes.max(initial=0)) + 1
        owner = np.repeat(np.arange(blocks), sizes)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.width, self.raw = width, np.zeros((blocks, width))
        self.raw[owner, within] = flat
        self.centre = np.bincount(owner, flat, blocks) / np.maximum(sizes, 1)
        x = self.raw - self.centre[:, None]
        self.step = np.diff(self.raw, axis=1, append=0.0)  # the step over a block's end is never read
        after = np.roll(x, -1, axis=1)
        self.x, self.xx, self.lag, self.d, self.dd = (self._sums(v) for v in (x, x * x, x * after, np.abs(self.step), self.step**2))

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        return np.cumsum(np.pad(values, ((0, 0), (1, 0))), axis=1)

    def describe(self, block: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """Rows of descriptors of the windows of `n` samples from `first` on in each block."""
        steps = n - 1

        def mean(sums: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
            return (sums[block, begin + size] - sums[block, begin]) / size

        def variance(begin: np.ndarray, size: int) -> np.ndarray:
            return np.maximum(mean(self.xx, begin, size) - mean(self.x, begin, size) ** 2, 0.0)

        # order statistics need the samples themselves: one sort gives them all
        samples = self.raw[block[:, None], first[:, None] + np.arange(n)]
        ranked = np.sort(samples, axis=1)
        spot = np.array([0.10, 0.25, 0.50, 0.75, 0.90]) * (n - 1)
        low = np.floor(spot).astype(int)
        quantile = ranked[:, low] + (ranked[:, np.minimum(low + 1, n - 1)] - ranked[:, low]) * (spot - low)
        centre, slope = mean(self.x, first, n), (samples[:, -1] - samples[:, 0]) / steps
        whole, early, late = variance(first, n), variance(first, steps), variance(first + 1, steps)
        wobble = np.maximum(mean(self.dd, first, steps) - slope**2, 0.0)
        # products of neighbours about the window mean, opened up into running sums
        product = mean(self.lag, first, steps) - centre * (mean(self.x, first, steps) + mean(self.x, first + 1, steps)) + centre**2
        # where a difference of sums has lost its digits, sum the few samples again
        level = mean(self.xx, np.zeros_like(first), self.width - 1)
        doubt = np.flatnonzero(np.minimum.reduce([whole, early, late, wobble]) <= 1e-6 * level)
        if len(doubt):
            about = samples[doubt] - samples[doubt].mean(axis=1)[:, None]
            whole[doubt], early[doubt], late[doubt] = about.var(axis=1), about[:, :-1].var(axis=1), about[:, 1:].var(axis=1)
            wobble[doubt] = np.diff(about, axis=1).var(axis=1)
            product[doubt] = np.einsum("ij,ij->i", about[:, :-1], about[:, 1:]) / steps
        found = {
            "mean": centre + self.centre[block], "std": np.sqrt(whole), "min": ranked[:, 0], "max": ranked[:, -1], "range": ranked[:, -1] - ranked[:, 0],
            "q10": quantile[:, 0], "q25": quantile[:, 1], "q50": quantile[:, 2], "q75": quantile[:, 3], "q90": quantile[:, 4],
            "start": samples[:, 0], "end": samples[:, -1], "endpoint_delta": samples[:, -1] - samples[:, 0], "diff_mean": slope, "diff_std": np.sqrt(wobble),
            "diff_abs_mean": mean(self.d, first, steps), "diff_abs_max": np.abs(self.step[block[:, None], first[:, None] + np.arange(steps)]).max(axis=1),
            "lag1": product / np.maximum(np.sqrt(early * late), 1e-6),
        }
        table = np.column_stack([found[name] for name in DESCRIPTORS])
        return np.where(np.isfinite(table), table, 0.0)


def describe_arrays(window: int, stride: int, batch: int = 32768):
    """Arrow UDF: block array, offset and window count -> array of descriptor arrays.

    Running sums are made once per Arrow batch, windows are described `batch` at a time.
    """

    @F.arrow_udf("array<array<double>>")
    def run(values: pa.Array, offset: pa.Array, count: pa.Array) -> pa.Array:
        counts = count.to_numpy(zero_copy_only=False).astype(np.int64)
        sums = _Running(values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy().astype(np.int64)))
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        block = np.repeat(np.arange(len(counts)), counts)
        first = offset.to_numpy(zero_copy_only=False).astype(np.int64)[block] + (np.arange(total) - np.repeat(ends - counts, counts)) * stride
        parts = [sums.describe(block[k : k + batch], first[k : k + batch], window).ravel() for k in range(0, total, batch)]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * len(DESCRIPTORS)), pa.array(np.concatenate([np.empty(0), *parts])))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), rows)

    return run


def descriptors(aligned: DataFrame, spec: WindowSpec, windows_per_block: int = 64) -> DataFrame:
    """`(run, channel, w, d)` with the window descriptors in `DESCRIPTORS` order.

    Five quantiles, moments and lagged products of overlapping windows have no single built-in
    aggregate; higher-order array functions run them interpreted, so the arithmetic on a block
    is one vectorised Arrow call.
    """
    blocks = _sample_blocks(aligned, spec, windows_per_block)
    fn = describe_arrays(spec.window, spec.stride)
    made = blocks.select("run", "channel", "w_lo", fn("_v", "_o", "n").alias("_d"))
    return made.select("run", "channel", "w_lo", F.posexplode("_d").alias("_i", "d")).select(
        "run", "channel", (F.col("w_lo") + F.col("_i")).alias("w"), "d"
    )


def long_features(described: DataFrame) -> DataFrame:
    """`(run, channel, w, descriptor, value)` rows."""
    names = F.array(*[F.lit(n) for n in DESCRIPTORS])
    return described.select(
        "run", "channel", "w", F.explode(F.arrays_zip(names.alias("descriptor"), F.col("d").alias("value"))).alias("f")
    ).select("run", "channel", "w", F.col("f.descriptor").alias("descriptor"), F.col("f.value").alias("value"))


def sample_weights(train_windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """How many training windows cover each pane of `stride` samples.

    Windows start on multiples of the stride; with a window that is no multiple of it the pane
    is the common divisor, so every sample of a pane has the same weight.
    """
    from math import gcd

    g = gcd(spec.window, spec.stride)
    lo = F.floor(F.col("w") * spec.stride / g).cast("long")
    panes = train_windows.withColumn("pane", F.explode(F.sequence(lo, lo + spec.window // g - 1)))
    return panes.groupBy("run", "pane").agg(F.count(F.lit(1)).alias("weight"))


def fit_scaler(aligned: DataFrame, train_windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Mean and deviation per channel, each sample weighted by the training windows covering it."""
    from math import gcd

    g = gcd(spec.window, spec.stride)
    weights = sample_weights(train_windows, spec)
    # a pane's samples share their weight, so they are added up before they meet it
    panes = aligned.groupBy("run", "channel", floor_div("k", g).alias("pane")).agg(
        F.count("*").alias("_n"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_ss")
    )
    weighted = panes.join(weights, ["run", "pane"])
    sums = weighted.groupBy("channel").agg(
        F.sum(F.col("weight") * F.col("_n")).alias("n"),
        F.sum(F.col("weight") * F.col("_s")).alias("s"),
        F.sum(F.col("weight") * F.col("_ss")).alias("ss"),
    )
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    std = F.sqrt(var)
    return sums.select("channel", "n", mean.alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def apply_scaler(aligned: DataFrame, scaler: DataFrame) -> DataFrame:
    return aligned.join(scaler.select("channel", "mean", "std"), "channel").withColumn(
        "value", (F.col("value") - F.col("mean")) / F.col("std")
    ).drop("mean", "std")
