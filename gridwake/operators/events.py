"""Event segments and event-level F1, without a sequential pass over a run.

True and predicted events are maximal stretches of ones.  A stretch in which both are one
belongs to exactly one (true, predicted) pair, so the overlapping pairs come out of the rows
in order and never need an interval join.  Neighbouring pairs share the true event, share the
predicted event, or share neither.  Matching greedily in time order then depends only on where
that kind last repeated or started afresh: counted from there, every second pair is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import floor_div, ratio
from gridwake.operators.metrics import f1_of
from gridwake.plans.ordered import nearest_points, prefix_sums, with_halo, with_row_ranges
from gridwake.session import stage

PAIR_BLOCK = 4096


def _flagged(scores: DataFrame, threshold: Column, by: Sequence[str], chunk_width: int) -> DataFrame:
    group = [] if by else ["group"]
    rows = scores.select(
        *by, *group, "start", (F.col("label") > 0).alias("lab"), (F.col("score") >= threshold).alias("hit")
    )
    if by:
        return rows.withColumns({"_chunk": floor_div("start", chunk_width), "_at": F.col("start")})
    # pooled: all runs form one sequence in (group, start) order
    return with_row_ranges(rows, ["group", "start"]).withColumn("_at", F.struct("group", "start"))


def _starts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running numbers of true events, predicted events and joint stretches."""
    point = {"at": F.col("_at"), "lab": F.col("lab"), "hit": F.col("hit")}
    seen = nearest_points(rows, by, "_chunk", ["_at"], point, strict=True, need="prev")
    p_lab, p_hit = F.coalesce("prev.lab", F.lit(False)), F.coalesce("prev.hit", F.lit(False))
    both = F.col("lab") & F.col("hit")
    seen = seen.withColumns({"_joint": both & ~(p_lab & p_hit), "_nt": F.col("lab") & ~p_lab, "_np": F.col("hit") & ~p_hit})
    sums = {"true_no": F.col("_nt").cast("long"), "pred_no": F.col("_np").cast("long"), "pair_no": F.col("_joint").cast("long")}
    return prefix_sums(seen.drop("prev", "points", "first", "last"), by, ["_chunk"], [F.col("_at")], sums)


def segments(rows: DataFrame, flag: str, by: Sequence[str], chunk_width: int) -> DataFrame:
    """Maximal stretches of `flag`: `(by, segment, first, last, length)`, ordered by `start`."""
    marked = rows.withColumns({"_chunk": floor_div("start", chunk_width), "_f": F.col(flag).cast("boolean")})
    seen = nearest_points(marked, by, "_chunk", ["start"], {"start": F.col("start"), "f": F.col("_f")}, strict=True, need="prev")
    opened = (F.col("_f") & ~F.coalesce("prev.f", F.lit(False))).cast("long")
    seen = seen.withColumn("_open", opened).drop("prev", "points", "first", "last")
    numbered = prefix_sums(seen, by, ["_chunk"], [F.col("start")], {"segment": F.col("_open")}).filter("_f")
    return numbered.groupBy(*by, "segment").agg(
        F.min("start").alias("first"), F.max("start").alias("last"), F.count(F.lit(1)).alias("length")
    )


def _taken(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mark the pairs the greedy rule matches."""
    spread = with_halo(pairs, "pair_no", PAIR_BLOCK, before=2)
    w = Window.partitionBy(*by, "_block").orderBy("pair_no")
    same_true = F.lag("true_no").over(w) == F.col("true_no")
    same_pred = F.lag("pred_no").over(w) == F.col("pred_no")
    kind = F.when(same_true, F.lit("t")).when(same_pred, F.lit("p")).otherwise(F.lit("n"))
    typed = spread.withColumn("kind", kind).withColumn("prior", F.lag("kind").over(w)).filter("_home")
    fresh = F.col("kind") == "n"
    reset = fresh | (F.col("kind") == F.col("prior"))
    typed = typed.withColumn("_chunk", floor_div("pair_no", PAIR_BLOCK)).drop("_block", "_home")
    point = {"pair_no": F.col("pair_no"), "fresh": fresh}
    near = nearest_points(typed, by, "_chunk", ["pair_no"], point, reset, need="prev", ranged=not by)
    odd = (F.col("pair_no") - F.col("prev.pair_no")) % 2 == 1
    return near.withColumn("taken", F.when(F.col("prev.fresh"), ~odd).otherwise(odd))


def event_f1(
    scores: DataFrame, threshold, by: Sequence[str] = ("group",), chunk_width: int = 1 << 16
) -> DataFrame:
    """Event precision, recall and F1 at `score >= threshold`.

    With `by` events never cross runs; with an empty `by` the runs are laid end to end and
    events may merge across them; that one sequence is cut into ranges of rows, so no task sees a
    row of every run.  `start` is the integer position inside a run.
    """
    by = list(by)
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    flagged = _starts(_flagged(scores, thr, by, chunk_width), by)
    numbered = stage(
        flagged.select(*by, "_joint", "pair_no", "true_no", "pred_no", "true_no_total", "pred_no_total")
    )
    totals = numbered.groupBy(*by).agg(F.max("true_no_total").alias("true_events"), F.max("pred_no_total").alias("pred_events"))
    pairs = numbered.filter("_joint").select(*by, "pair_no", "true_no", "pred_no")
    matched = _taken(pairs, by).groupBy(*by).agg(F.sum(F.col("taken").cast("long")).alias("matched"))
    if by:
        out = totals.join(matched, by, "left")
    else:
        out = totals.withColumn("matched", matched.scalar())
    return out.withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))


def event_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pool `event_f1` counts into precision, recall and F1."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("true_events", "pred_events", "matched")])
    p = ratio("matched", F.greatest(F.lit(1), F.col("pred_events")))
    rec = ratio("matched", F.greatest(F.lit(1), F.col("true_events")))
    return sums.withColumns({"event_precision": p, "event_recall": rec, "event_f1": f1_of(p, rec)})
