"""Exact quantiles of groups of any size.

`percentile` keeps every distinct value of a group in one task.  Here the values are counted
per (group, value), scanned by value range and the wanted ranks are picked from the running
counts, so a group is spread over as many tasks as there are value ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import ceil_rank, is_finite, require
from gridwake.plans.ordered import nearest_points, prefix_sums, value_cuts, with_range_chunk
from gridwake.session import stage


def value_ranks(
    df: DataFrame, by: Sequence[str], value: str, cuts: Sequence[float] | None = None, descending: bool = False,
    copies: str | None = None,
) -> DataFrame:
    """One row per distinct value: `n` copies, `cum` rows up to and with it, `cum_total` rows in all."""
    cuts = value_cuts(df, value) if cuts is None else cuts
    count = F.count(F.lit(1)) if copies is None else F.sum(copies)
    counted = df.groupBy(*by, value).agg(count.alias("n"))
    chunked = with_range_chunk(counted, value, cuts)
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    return prefix_sums(chunked, by, ["_chunk"], order, {"cum": F.col("n")}, descending).drop("_chunk")


def _at(rank: Column, value: str) -> Column:
    hit = (F.col("cum") - F.col("n") <= rank) & (rank < F.col("cum"))
    return F.max(F.when(hit, F.col(value)))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    outputs: Mapping[str, tuple[float, str]],
    cuts: Sequence[float] | None = None,
    copies: str | None = None,
) -> DataFrame:
    """Exact quantiles per group; each output is `(q, "higher" | "linear")`, plus the count `n`.

    `copies` names a column with the multiplicity of pre-counted rows.  NULL means no value; a value
    that is not finite fails the job, as no comparison with it would ever hold.
    """
    present = df.filter(F.col(value).isNotNull())
    present = present.withColumn(value, require(is_finite(value), value, f"{value} is not finite"))
    ranked = value_ranks(present, by, value, cuts, copies=copies)
    total = F.col("cum_total")
    aggs: list[Column] = [F.max(total).alias("n")]
    finals: list[Column] = [F.col("n")]
    for name, (q, kind) in outputs.items():
        if kind == "higher":
            aggs.append(_at(ceil_rank(F.lit(q), total), value).alias(name))
            finals.append(F.col(name))
            continue
        position = F.lit(float(q)) * (total - 1)
        aggs.append(_at(F.floor(position), value).alias(f"_{name}_lo"))
        aggs.append(_at(F.ceil(position), value).alias(f"_{name}_hi"))
        spot = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        finals.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return ranked.groupBy(*by).agg(*aggs).select(*by, *finals)


def quantile_higher(df: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "threshold",
                    cuts: Sequence[float] | None = None) -> DataFrame:
    if not 0 < q <= 1:
        raise ValueError("quantile must lie in (0, 1]")
    out = quantiles(df, by, value, {name: (q, "higher")}, cuts)
    return out.withColumn(name, require(F.coalesce(F.col("n"), F.lit(0)) > 0, name, f"no {value} to calibrate on"))


def top_mean(df: DataFrame, by: Sequence[str], value: str, fraction: float, name: str = "top_mean",
             cuts: Sequence[float] | None = None) -> DataFrame:
    """Mean of the `max(1, ceil(n * fraction))` largest values, with mean, max and count."""
    ranked = value_ranks(df, by, value, cuts, descending=True)
    keep = F.greatest(F.lit(1), F.ceil(F.col("cum_total") * F.lit(float(fraction)))).cast("long")
    taken = F.greatest(F.lit(0), F.least(F.col("n"), keep - (F.col("cum") - F.col("n"))))
    return (
        ranked.withColumns({"_keep": keep, "_taken": taken})
        .groupBy(*by)
        .agg(
            (F.sum(F.col(value) * F.col("_taken")) / F.max("_keep")).alias(name),
            (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
            F.max(value).alias("max"),
            F.sum("n").alias("n"),
        )
    )


#: Ranks that one task looks up at a time.
RANKS = 1 << 16


def leave_out_quantiles(df: DataFrame, folds: DataFrame, group: str, value: str, q: float, name: str = "threshold") -> DataFrame:
    """`(group, name)`: the upper quantile of the values of all other groups, for each group in `folds`.

    Values are counted once, not once per fold. Of the others' values as many are at or below one of the
    group's own as the running count of all says less the group's own. The last own value with at most
    the wanted rank of them below tells how many own values to pass over; the rank moved on by that many
    is then looked up in the running counts of all. A group without any other value has no row.
    """
    df = df.filter(F.col(value).isNotNull()).withColumn(value, require(is_finite(value), value, f"{value} is not finite"))
    cuts = value_cuts(df, value)
    counted = stage(df.groupBy(group, value).agg(F.count(F.lit(1)).alias("copies")))
    whole = value_ranks(counted, [], value, cuts, copies="copies")
    own = value_ranks(counted, [group], value, cuts, copies="copies")
    everything = F.coalesce(counted.agg(F.sum("copies")).scalar(), F.lit(0))
    sizes = counted.groupBy(group).agg(F.sum("copies").alias("_own"))
    left = everything - F.coalesce("_own", F.lit(0))
    wanted = folds.select(group).distinct().join(sizes, group, "left").select(group, left.alias("_left")).filter("_left > 0")
    wanted = wanted.withColumn("_rank", ceil_rank(F.lit(q), F.col("_left")))
    met = own.join(whole.select(value, F.col("cum").alias("_all")), value).join(wanted.select(group, "_rank"), group)
    passed = met.groupBy(group).agg(F.max(F.when(F.col("_all") - F.col("cum") <= F.col("_rank"), F.col("cum"))).alias("_passed"))
    targets = wanted.join(passed, group, "left").select(group, (F.col("_rank") + F.coalesce("_passed", F.lit(0))).alias("pos"), F.lit(0).alias("_point"))
    points = whole.select((F.col("cum") - 1).alias("pos"), value, F.lit(1).alias("_point"))
    rows = points.unionByName(targets, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("pos") / RANKS))
    near = nearest_points(rows, [], "_chunk", ["pos", "_point"], {"pos": F.col("pos"), "value": F.col(value)}, F.col("_point") == 1, need="next")
    return near.filter("_point = 0").select(group, F.col("next.value").alias(name))
