"""Detection and classification metrics.

Curves are built on distinct scores: ties are collapsed by a map-side combined count before
the ordered scan, and the scan itself is split by score range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions.numeric import as_col, is_finite, ratio, ratio0, require
from gridwake.plans.ordered import prefix_sums, value_cuts, with_range_chunk


def score_curve(scores: DataFrame, by: Sequence[str] = (), weight: str | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    """Per distinct score: `pos`, `n` at it, `tp`, `seen` at or above it, and the group totals.

    A score that is not finite fails the job; it would otherwise rank above all others.
    """
    scores = scores.withColumn("score", require(is_finite("score"), "score", "scores must be finite"))
    cuts = value_cuts(scores, "score") if cuts is None else cuts
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    counted = scores.groupBy(*by, "score").agg(F.sum(F.col("label") * w).alias("pos"), F.sum(w).alias("n"))
    chunked = with_range_chunk(counted, "score", cuts)
    sums = {"tp": F.col("pos"), "seen": F.col("n")}
    return prefix_sums(chunked, by, ["_chunk"], [F.col("score").desc()], sums, descending_chunks=True).drop("_chunk")


def curve_ap() -> Column:
    """Average precision over the rows of a score curve; NULL without positives."""
    step = F.col("pos") * ratio0("tp", "seen")
    return F.try_divide(F.sum(step).cast("double"), F.max("tp_total").cast("double"))


def curve_auroc() -> Column:
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("tp") - F.col("pos") + F.col("pos") * F.lit(0.5)))
    p, total = F.max("tp_total"), F.max("seen_total")
    return F.try_divide(won.cast("double"), (p * (total - p)).cast("double"))


def average_precision(scores: DataFrame, by: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    return score_curve(scores, by, cuts=cuts).groupBy(*by).agg(curve_ap().alias("auprc"))


def auroc(scores: DataFrame, by: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    return score_curve(scores, by, cuts=cuts).groupBy(*by).agg(curve_auroc().alias("auroc"))


def f1_of(precision: Column, recall: Column) -> Column:
    return F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def best_f1(scores: DataFrame, by: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """Best F1 over all score thresholds and the lowest threshold that reaches it."""
    curve = score_curve(scores, by, cuts=cuts)
    f1 = f1_of(ratio0("tp", "seen"), ratio0("tp", "tp_total"))
    best = curve.withColumn("f1", f1).groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("m"))).alias("b"))
    return best.select(*by, F.col("b.f1").alias("best_f1"), (-F.col("b.m")).alias("threshold"))


def point_metrics(scores: DataFrame, threshold, by: Sequence[str] = ()) -> DataFrame:
    """F1 and positive rate at a frozen threshold (`score >= threshold`); a score that is not finite fails the job."""
    hit = (require(is_finite("score"), "score", "scores must be finite") >= as_col(threshold)).cast("long")
    sums = scores.groupBy(*by).agg(
        F.sum(hit * F.col("label")).alias("tp"), F.sum(hit).alias("pp"), F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")
    )
    f1 = ratio0(2 * F.col("tp"), F.col("pp") + F.col("p"))
    return sums.select(*by, f1.alias("f1"), ratio("pp", "n").alias("positive_rate"), "n")


def gate_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP/FP/FN/TN windows and distinct runs, recall and precision of a gate against truth."""
    t, g = F.col("truth") == 1, F.col("gate")
    buckets = {"tp": t & g, "fn": t & ~g, "fp": ~t & g, "tn": ~t & ~g}
    per_run = df.groupBy(*by, "run").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in buckets.items()])
    out = per_run.groupBy(*by).agg(
        *[F.sum(n).alias(f"{n}_windows") for n in buckets],
        *[F.count(F.when(F.col(n) > 0, 1)).alias(f"{n}_runs") for n in buckets],
    )
    return out.withColumns(
        {
            "recall": ratio("tp_windows", F.col("tp_windows") + F.col("fn_windows")),
            "precision": ratio("tp_windows", F.col("tp_windows") + F.col("fp_windows")),
        }
    )


def confusion(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by, "true_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"))


def per_class_metrics(conf: DataFrame, labels: Sequence[int], by: Sequence[str] = (), weight: str = "n") -> DataFrame:
    """Precision, recall, F1 and support of every listed label, absent ones included as 0."""
    w = F.col(weight)
    t, p = F.col("true_class"), F.col("predicted_class")
    aggs = []
    for c in labels:
        aggs += [
            F.sum(F.when((t == c) & (p == c), w).otherwise(0)).alias(f"_tp{c}"),
            F.sum(F.when(p == c, w).otherwise(0)).alias(f"_pp{c}"),
            F.sum(F.when(t == c, w).otherwise(0)).alias(f"_st{c}"),
        ]
    aggs += [F.sum(F.when(t == p, w).otherwise(0)).alias("correct"), F.sum(w).alias("total")]
    wide = conf.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).cast("long").alias("class_id"),
                F.col(f"_tp{c}").alias("tp"),
                F.col(f"_pp{c}").alias("pp"),
                F.col(f"_st{c}").alias("support"),
            )
            for c in labels
        ]
    )
    out = wide.select(*by, "correct", "total", F.explode(rows).alias("r")).select(*by, "correct", "total", "r.*")
    return out.withColumns(
        {
            "precision": ratio0("tp", "pp"),
            "recall": ratio0("tp", "support"),
            "f1": ratio0(2 * F.col("tp"), F.col("pp") + F.col("support")),
        }
    )


def class_metrics(conf: DataFrame, labels: Sequence[int], by: Sequence[str] = (), weight: str = "n") -> DataFrame:
    rows = per_class_metrics(conf, labels, by, weight)
    return rows.groupBy(*by).agg(
        ratio(F.max("correct"), F.max("total")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("recall").alias("balanced_accuracy"),
        ratio0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def anomaly_only(preds: DataFrame, labels: Sequence[int] = (1, 2, 3, 4), by: Sequence[str] = ()) -> DataFrame:
    """Class metrics restricted to truly anomalous rows."""
    return class_metrics(confusion(preds.filter("true_class > 0"), by), labels, by)


def ovr_metrics(probs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest macro AUPRC and AUROC from `(true_class, class_id, probability)` rows."""
    scores = probs.select(
        *by, "class_id", F.col("probability").alias("score"), (F.col("true_class") == F.col("class_id")).cast("long").alias("label")
    )
    per = score_curve(scores, [*by, "class_id"]).groupBy(*by, "class_id").agg(curve_ap().alias("ap"), curve_auroc().alias("roc"))
    return per.groupBy(*by).agg(F.avg("ap").alias("macro_ovr_auprc"), F.avg("roc").alias("macro_ovr_auroc"))


def family_metrics(scores: DataFrame, family: str = "family", none: str = "none") -> DataFrame:
    """AUPRC/AUROC of every fault family against all faultless rows; one-class subsets are skipped.

    Faultless rows are counted once, in one running count over all distinct scores that every family
    looks its own scores up in; both areas are sums over the family's scores alone.
    """
    scores = scores.withColumn("score", require(is_finite("score"), "score", "scores must be finite"))
    cuts = value_cuts(scores, "score")
    healthy = (F.col(family) == none).cast("long")
    shared = with_range_chunk(scores.groupBy("score").agg(F.sum(healthy).alias("h_at")), "score", cuts)
    shared = prefix_sums(shared, [], ["_chunk"], [F.col("score").desc()], {"h": F.col("h_at")}, descending_chunks=True).select("score", "h_at", "h", "h_total")
    own = scores.filter(F.col(family) != none).groupBy(family, "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    curve = prefix_sums(
        with_range_chunk(own, "score", cuts), [family], ["_chunk"], [F.col("score").desc()], {"tp": F.col("pos"), "seen": F.col("n")}, descending_chunks=True
    )
    curve = curve.drop("_chunk").join(shared, "score")
    negatives = F.col("seen_total") - F.col("tp_total") + F.col("h_total")
    above, at = F.col("seen") - F.col("tp") + F.col("h"), F.col("n") - F.col("pos") + F.col("h_at")
    step = F.col("pos") * F.try_divide(F.col("tp").cast("double"), F.col("seen") + F.col("h"))
    won = F.col("pos") * (negatives - above + at * F.lit(0.5))
    p = F.max("tp_total")
    out = curve.groupBy(family).agg(
        F.try_divide(F.sum(step), p).alias("auprc"), F.try_divide(F.sum(won), (p * F.max(negatives)).cast("double")).alias("auroc"), p.alias("positives"),
        F.max(F.col("seen_total") + F.col("h_total")).alias("rows"),
    )
    return out.filter((F.col("positives") > 0) & (F.col("positives") < F.col("rows")))


def screen_metrics(flights: DataFrame, threshold) -> DataFrame:
    """Recall, specificity and F1 of flight-level screening: unknown is positive, `score > threshold`."""
    hit = F.col("score") > as_col(threshold)
    unknown = F.col("kind") == "unknown"
    sums = flights.groupBy().agg(
        F.count(F.when(unknown & hit, 1)).alias("tp"), F.count(F.when(unknown, 1)).alias("p"),
        F.count(F.when(~unknown & hit, 1)).alias("fp"), F.count(F.when(~unknown, 1)).alias("neg"),
    )
    return sums.select(
        "tp", "fp",
        ratio("tp", "p").alias("recall"),
        ratio(F.col("neg") - F.col("fp"), "neg").alias("specificity"),
        ratio0(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"),
    )


def localization_by_run(rankings: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Rank of the true module per run; an unavailable rank scores 0 and EXAM 1."""
    hit = F.min(F.when(F.col("module") == F.col("truth"), F.col("rank")))
    per = rankings.groupBy(*by, "run").agg(hit.alias("truth_rank"), F.count_distinct("module").alias("modules"))
    return per.withColumns(
        {
            "rr": F.coalesce(F.lit(1.0) / F.col("truth_rank"), F.lit(0.0)),
            "exam": F.coalesce(ratio("truth_rank", "modules"), F.lit(1.0)),
            **{f"top{k}": F.coalesce((F.col("truth_rank") <= k).cast("double"), F.lit(0.0)) for k in ks},
        }
    )


def localization_metrics(rankings: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    per = localization_by_run(rankings, by, ks)
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("rr").alias("mrr"), F.avg("exam").alias("exam"),
        *[F.avg(f"top{k}").alias(f"top{k}") for k in ks],
    )


def alarms_by_run(windows: DataFrame, onset: float, by: Sequence[str] = ("run",)) -> DataFrame:
    """Per run: any alarm, detection after onset, alarm before it, first alarm and delay."""
    t, g = F.col("t"), F.col("gate")
    out = windows.groupBy(*by).agg(
        F.max(g).alias("any_alarm"),
        F.max(g & (t >= onset)).alias("detected"),
        F.max(g & (t < onset)).alias("pre_onset_alarm"),
        F.min(F.when(g, t)).alias("first_alarm_s"),
        (F.min(F.when(g & (t >= onset), t)) - F.lit(onset)).alias("delay_s"),
    )
    return out


def alarm_summary(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detection summary of `alarms_by_run` rows with `condition`, `pair` and `source`.

    A clean detection is a detected fault without an early alarm whose paired normal is silent.
    """
    keys = [*by, "pair"]
    silent = runs.filter("condition = 'normal'").groupBy(*keys).agg(F.max("any_alarm").alias("normal_alarm"))
    j = runs.join(silent, keys, "left")
    fault, normal = F.col("condition") == "fault", F.col("condition") == "normal"
    clean = fault & F.col("detected") & ~F.col("pre_onset_alarm") & ~F.coalesce("normal_alarm", F.lit(True))
    out = j.groupBy(*by).agg(
        F.count(F.when(fault, 1)).alias("fault_runs"),
        F.count(F.when(fault & F.col("detected"), 1)).alias("detected_runs"),
        F.count(F.when(normal, 1)).alias("normal_runs"),
        F.count(F.when(normal & F.col("any_alarm"), 1)).alias("normal_alarm_runs"),
        F.count_distinct(F.when(normal & F.col("any_alarm"), F.col("source"))).alias("normal_alarm_sources"),
        F.count(F.when(fault & F.col("pre_onset_alarm"), 1)).alias("pre_onset_runs"),
        F.count(F.when(clean, 1)).alias("clean_detections"),
        F.min(F.when(fault & F.col("detected"), F.col("delay_s"))).alias("delay_min_s"),
        F.max(F.when(fault & F.col("detected"), F.col("delay_s"))).alias("delay_max_s"),
    )
    return out.withColumns(
        {"detector_recall": ratio("detected_runs", "fault_runs"), "misses": F.col("fault_runs") - F.col("detected_runs")}
    )


def relative_to(df: DataFrame, base: str, key: str, value: str, name: str = "variant") -> DataFrame:
    """Value over the value of the `base` variant with the same key."""
    ref = df.filter(F.col(name) == base).select(key, F.col(value).alias("_base"))
    return df.join(ref, key, "left").withColumn("relative", ratio(value, "_base")).drop("_base")


def frontier(maxima: DataFrame, limit: int) -> DataFrame:
    """Normal alarms and fault detections for every candidate threshold, and whether the
    threshold gives the best recall with at most `limit` alarms."""
    flags = maxima.select(
        F.col("maximum").alias("threshold"),
        (F.col("condition") == "normal").cast("long").alias("nrm"),
        (F.col("condition") == "fault").cast("long").alias("flt"),
    )
    cuts = value_cuts(flags, "threshold")
    zero = flags.select(F.lit(0.0).alias("threshold"), F.lit(0).cast("long").alias("nrm"), F.lit(0).cast("long").alias("flt")).limit(1)
    counted = flags.unionByName(zero).groupBy("threshold").agg(F.sum("nrm").alias("nrm"), F.sum("flt").alias("flt"))
    run = prefix_sums(
        with_range_chunk(counted, "threshold", cuts), [], ["_chunk"], [F.col("threshold")], {"n": F.col("nrm"), "f": F.col("flt")}
    )
    pts = run.select(
        "threshold", (F.col("n_total") - F.col("n")).alias("normal_alarms"), (F.col("f_total") - F.col("f")).alias("fault_detections")
    )
    best = pts.filter(F.col("normal_alarms") <= limit).agg(F.max("fault_detections")).scalar()
    return pts.withColumn("best", (F.col("normal_alarms") <= limit) & (F.col("fault_detections") == best))


def separation(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.max(F.when(F.col("condition") == "normal", F.col("maximum"))).alias("normal_max"),
        F.min(F.when(F.col("condition") == "fault", F.col("maximum"))).alias("fault_min"),
        F.max(F.when(F.col("condition") == "fault", F.col("maximum"))).alias("fault_max"),
    )
