"""Index-aligned sliding windows expressed through panes.

Samples are first combined per pane (`gcd` of stride and span), so only one row per pane is
spread to the windows that cover it, and both steps combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import as_col


@dataclass(frozen=True)
class WindowSpec:
    window: int = 96
    stride: int = 8
    horizon: int = 12
    frequency_hz: float = 10.0

    @property
    def step_us(self) -> int:
        return max(1, round(1e6 / self.frequency_hz))

    @property
    def span(self) -> int:
        return self.window + self.horizon

    @property
    def purge(self) -> int:
        return -(-self.span // self.stride)


RANGE_BLOCK = 4096


def explode_range(df: DataFrame, count: str, name: str, key: str = "run", block: int = RANGE_BLOCK) -> DataFrame:
    """Rows 0..count-1 of every input row, made block by block; none where the count is not positive.

    Only block rows are shuffled before they are filled, so one very long run is generated by
    many tasks and never as one array.  The planner takes the rows for as few as the blocks, so a
    join is told to merge: else it would broadcast all of them through the driver.
    """
    last = F.floor((F.col(count) - 1) / F.lit(block)).cast("long")
    blocks = df.filter(F.col(count) > 0).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(key, "_b")
    lo = F.col("_b") * block
    return blocks.withColumn(name, F.explode(F.sequence(lo, F.least(lo + block, F.col(count)) - 1))).drop("_b").hint("merge")


def window_count(rows, spec: WindowSpec) -> Column:
    limit = as_col(rows) - spec.window - spec.horizon + 1
    return F.when(limit <= 0, F.lit(0)).otherwise(F.floor((limit - 1) / spec.stride) + 1).cast("long")


def window_starts(runs: DataFrame, spec: WindowSpec, rows: str = "rows") -> DataFrame:
    """`w` and `start_k` for every full window of a run, with the run's window count."""
    counted = runs.withColumn("n_windows", window_count(rows, spec)).filter("n_windows > 0")
    return explode_range(counted, "n_windows", "w").withColumn("start_k", F.col("w") * spec.stride)


def covering_windows(lo: Column, hi: Column, span: int, stride: int) -> Column:
    """Window numbers that overlap the sample positions lo..hi (inclusive)."""
    first = F.greatest(F.lit(0), F.ceil((lo - span + 1) / stride)).cast("long")
    last = F.floor(hi / stride).cast("long")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def pane_size(span: int, stride: int) -> int:
    return gcd(span, stride)


def reduce_to_windows(
    points: DataFrame,
    by: Sequence[str],
    index: str,
    span: int,
    stride: int,
    combine: dict[str, tuple[str, str]],
) -> DataFrame:
    """Aggregate samples into the windows covering them.

    `combine` maps an output to `(input, function)` with an associative function: sum, max or min.
    """
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    g = pane_size(span, stride)
    pane = F.floor(F.col(index) / g).cast("long")
    panes = points.groupBy(*by, pane.alias("_pane")).agg(
        *[fn[f](c).alias(n) for n, (c, f) in combine.items()]
    )
    lo = F.col("_pane") * g
    spread = panes.withColumn("w", F.explode(covering_windows(lo, lo + g - 1, span, stride)))
    return spread.groupBy(*by, "w").agg(*[fn[f](n).alias(n) for n, (_, f) in combine.items()])
