"""Ordered computations that never put one whole group into one task.

A plain `Window.partitionBy(run)` sends every row of a run to one task; one run may hold a
third of the data.  Each function here takes `chunk` columns, a coarse key that follows the
sort order (a time bucket or a value range).  Rows are windowed inside `(by, chunk)`, the
chunks are summarised to one row each, the summaries are scanned in order and joined back.
The shuffle key of the large side is always `(by, chunk)`, so the join and the window share
one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import floor_div
from gridwake.session import parallelism, stage

#: Ranges into which a long list of chunk summaries is cut, and sampled chunks behind each boundary.
RANGES = 256
_PER_RANGE = 16
#: Rows of a range of one long sequence.
ROWS = 1 << 17
#: Rows of a time chunk above which it is cut, and its parts at most.
DENSE = 1 << 18
PARTS = 256


def _directed(names: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(n).desc() if descending else F.col(n).asc() for n in names]


def value_cuts(df: DataFrame, column: str, parts: int | None = None) -> list[float]:
    """Split points of a numeric column: at most `parts` doubles reach the driver.

    They decide only how evenly the work is spread, never the result.
    """
    parts = parts or min(parallelism(df.sparkSession), 2000)
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(column, probs, 1.0 / (4 * parts))))


def with_range_chunk(df: DataFrame, column: str, cuts: Sequence[float], name: str = "_chunk") -> DataFrame:
    """Add the index of the value range a row falls into."""
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def with_time_chunk(df: DataFrame, by: Sequence[str], at: str, width: int, rows: int | None = None) -> DataFrame:
    """Add `_chunk(t, part)`: the time bucket of `width`, and its equally filled part where rows are dense.

    A bucket of a series with more than `rows` rows is cut at quantiles of their times, which come from a
    mergeable sketch. Only such buckets are listed, so the list has one boundary per `rows` rows at most; the
    boundaries steer balance, never the result.
    """
    by, rows = list(by), rows or DENSE
    timed = df.select(*by, at, floor_div(at, width).alias("_t"))
    crowded = stage(timed.groupBy(*by, "_t").agg(F.count("*").alias("_n")).filter(F.col("_n") > rows))
    bucket = floor_div(at, width)
    if crowded.isEmpty():
        return df.withColumn("_chunk", F.struct(bucket.alias("t"), F.lit(0).alias("part")))
    probabilities = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    sketch = F.percentile_approx(at, probabilities, F.lit(4 * PARTS))
    step = F.greatest(F.lit(1), F.floor(F.lit(PARTS * rows) / F.col("_n"))).cast("int")
    cut = timed.join(crowded, [*by, "_t"]).groupBy(*by, "_t", "_n").agg(sketch.alias("_all"))
    cut = stage(cut.select(*by, "_t", F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % step == 0)).alias("_cuts")))
    marked = df.withColumn("_t", bucket).join(cut, [*by, "_t"], "left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(at))), F.lit(0))
    return marked.withColumn("_chunk", F.struct(F.col("_t").alias("t"), part.alias("part"))).drop("_t", "_cuts")


def with_ranges(summary: DataFrame, chunk: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Add `_range`, which cuts the chunks of a staged summary, in order, into about equally long ranges.

    Boundaries are a sample of the chunks by hash, of fixed size, and thus the same after a retry.
    """
    key = F.struct(*chunk)
    drawn = summary.select(key.alias("c")).orderBy(F.xxhash64("c"), "c").limit(ranges * _PER_RANGE)
    inner = drawn.agg(F.sort_array(F.collect_list("c")).alias("c"))
    thin = inner.select(F.filter("c", lambda _, i: (i + 1) % _PER_RANGE == 0).alias("c"))
    cut = summary.withColumn("_cuts", thin.scalar())
    return cut.withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= key))).drop("_cuts")


def with_row_ranges(df: DataFrame, order: Sequence[str], rows: int | None = None, name: str = "_chunk") -> DataFrame:
    """Staged rows with the number of their range in `order`; ranges hold about `rows` rows each.

    The ranges are those of Spark's range partitioning, kept by the staged copy, so their number follows the
    rows whatever the groups are.  Equal keys share a range.
    """
    count = -(-df.count() // (rows or ROWS))
    return stage(df.repartitionByRange(max(1, count), *order).withColumn(name, F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    by: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending_chunks: bool = False,
    ranged: bool = False,
) -> DataFrame:
    """Inclusive running sums `<name>` and group totals `<name>_total`.

    `ranged` scans the chunk summaries themselves by ranges, for groups with very many chunks; the
    sums should then be whole numbers, which add up alike in any order.
    """
    by, chunk = list(by), list(chunk)
    items = {n: F.coalesce(e, F.lit(0)) for n, e in sums.items()}
    parts = df.groupBy(*by, *chunk).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in items.items()])
    if ranged:
        way = _directed(chunk, descending_chunks)
        placed = prefix_sums(with_ranges(stage(parts), chunk), by, ["_range"], way, {n: F.col(f"_s_{n}") for n in items}, descending_chunks)
        own = [(F.col(n) - F.col(f"_s_{n}")).alias(f"_o_{n}") for n in items]
        offsets = placed.select(*by, *chunk, *own, *[f"{n}_total" for n in items])
        return _with_offsets(df, by, chunk, order, items, offsets)
    before = (
        Window.partitionBy(*by)
        .orderBy(*_directed(chunk, descending_chunks))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.select(
        *by,
        *chunk,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in items],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*by)).alias(f"{n}_total") for n in items],
    )
    return _with_offsets(df, by, chunk, order, items, offsets)


def _with_offsets(
    df: DataFrame, by: list[str], chunk: list[str], order: Sequence[Column], items: Mapping[str, Column], offsets: DataFrame
) -> DataFrame:
    """Running sums inside each chunk, plus what stands before the chunk."""
    local = Window.partitionBy(*by, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = df.select("*", *[F.sum(e).over(local).alias(f"_l_{n}") for n, e in items.items()])
    out = scanned.join(offsets, by + chunk)
    out = out.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in items})
    return out.drop(*[f"_l_{n}" for n in items], *[f"_o_{n}" for n in items])


def dense_index(
    df: DataFrame,
    by: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[Column],
    name: str = "idx",
    descending_chunks: bool = False,
) -> DataFrame:
    """0-based position in the group (`name`) and the group size (`name_total`)."""
    out = prefix_sums(df, by, chunk, order, {name: F.lit(1).cast("long")}, descending_chunks)
    return out.withColumn(name, F.col(name) - 1)


def nearest_points(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str],
    point: Mapping[str, Column],
    has: Column | None = None,
    strict: bool = False,
    need: str = "both",
    ranged: bool = False,
) -> DataFrame:
    """Attach `prev` (last point up to this row) and `next` (first one from this row on).

    `point` names the fields of a point; the first one is its position and must grow with
    `order`.  Rows where `has` is false carry none.  `strict` leaves the row itself out of
    `prev`.  `points` is the number of points in the group, `first` and `last` its outermost.
    `ranged` scans the chunk summaries by ranges, for groups with very many chunks.
    """
    by, names = list(by), list(point)
    at = names[0]
    has = F.lit(True) if has is None else has
    fields = {n: F.when(has, e) for n, e in point.items()}
    df = df.withColumns({f"_p_{n}": e for n, e in fields.items()})
    pos = F.col(f"_p_{at}")
    # plain min/max/max_by buffers keep this a hash aggregate with map-side combine
    ends = {}
    for n in names:
        ends[f"_lo_{n}"] = F.min(pos) if n == at else F.min_by(f"_p_{n}", pos)
        ends[f"_hi_{n}"] = F.max(pos) if n == at else F.max_by(f"_p_{n}", pos)
    summary = df.groupBy(*by, chunk).agg(F.count(pos).alias("_n"), *[e.alias(n) for n, e in ends.items()])

    def as_point(prefix: str) -> Column:
        return F.when(F.col(f"{prefix}_{at}").isNotNull(), F.struct(*[F.col(f"{prefix}_{n}").alias(n) for n in names]))

    summary = summary.select(*by, chunk, "_n", as_point("_lo").alias("_lo"), as_point("_hi").alias("_hi"))
    carried = _carried_by_range(with_ranges(stage(summary), [chunk]), by, chunk) if ranged else _carried(summary, by, chunk)
    home = Window.partitionBy(*by, chunk)
    fwd = home.orderBy(*[F.col(o) for o in order])
    bwd = home.orderBy(*[F.col(o).desc() for o in order])
    own = as_point("_p")
    cols: dict[str, Column] = {}
    if need in ("both", "prev"):
        end = -1 if strict else 0
        cols["_l1"] = F.last(own, ignorenulls=True).over(fwd.rowsBetween(Window.unboundedPreceding, end))
    if need in ("both", "next"):
        cols["_l2"] = F.last(own, ignorenulls=True).over(bwd.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns(cols).drop(*[f"_p_{n}" for n in names]).join(carried, [*by, chunk])
    if "_l1" in cols:
        out = out.withColumn("prev", F.coalesce("_l1", "_cp"))
    if "_l2" in cols:
        out = out.withColumn("next", F.coalesce("_l2", "_cn"))
    return out.drop("_l1", "_l2", "_cp", "_cn")


def _carried(summary: DataFrame, by: list[str], chunk: str) -> DataFrame:
    """Per chunk the last point before it, the first after it, and number and ends of the group's points."""
    seq = Window.partitionBy(*by).orderBy(F.col(chunk))
    rev = Window.partitionBy(*by).orderBy(F.col(chunk).desc())
    whole = Window.partitionBy(*by)
    upto = (Window.unboundedPreceding, -1)
    return summary.select(
        *by,
        chunk,
        F.last("_hi", ignorenulls=True).over(seq.rowsBetween(*upto)).alias("_cp"),
        F.last("_lo", ignorenulls=True).over(rev.rowsBetween(*upto)).alias("_cn"),
        F.sum("_n").over(whole).alias("points"),
        F.min("_lo").over(whole).alias("first"),
        F.max("_hi").over(whole).alias("last"),
    )


def _carried_by_range(summary: DataFrame, by: list[str], chunk: str) -> DataFrame:
    """The same in two levels: chunks inside a range, then one row per range."""
    tops = summary.groupBy(*by, "_range").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    outer = _carried(tops, by, "_range").withColumnsRenamed({"_cp": "_op", "_cn": "_on"})
    inner = _carried(summary, [*by, "_range"], chunk).drop("points", "first", "last")
    return inner.join(outer, [*by, "_range"]).select(
        *by, chunk, F.coalesce("_cp", "_op").alias("_cp"), F.coalesce("_cn", "_on").alias("_cn"), "points", "first", "last"
    )


def with_halo(df: DataFrame, index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut a dense index into blocks and copy edge rows into the neighbour block.

    Adds `_block` and `_home`; after windowing on `_block`, keep `_home` rows.  With
    `before <= size` a frame of `before` preceding rows is complete for every home row.
    """
    if max(before, after) > size:
        raise ValueError("halo must not exceed the block size")
    idx = F.col(index)
    block = F.floor(idx / size).cast("long")
    pos = idx - block * size
    copies = [F.struct(block.alias("b"), F.lit(True).alias("h"))]
    if before:
        copies.append(F.when(pos >= size - before, F.struct((block + 1).alias("b"), F.lit(False).alias("h"))))
    if after:
        copies.append(F.when(pos < after, F.struct((block - 1).alias("b"), F.lit(False).alias("h"))))
    spread = F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())).alias("_c")
    return df.select("*", spread).select(
        *df.columns, F.col("_c.b").alias("_block"), F.col("_c.h").alias("_home")
    )


def rolling(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    frame: int,
    outputs: Mapping[str, Column],
    size: int = 4096,
) -> DataFrame:
    """Aggregates over the current row and the `frame - 1` rows before it, by dense index."""
    size = max(size, frame)
    spread = with_halo(df, index, size, before=frame - 1)
    w = Window.partitionBy(*by, "_block").orderBy(index).rowsBetween(-(frame - 1), 0)
    out = spread.select("*", *[e.over(w).alias(n) for n, e in outputs.items()])
    return out.filter("_home").drop("_block", "_home")
