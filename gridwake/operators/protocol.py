"""Freeze, predict, score: three jobs with digests between them and truth only in the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.operators import calibration as C
from gridwake.operators import metrics as M
from gridwake.operators import propagation as Pr
from gridwake.session import shared_dir
from gridwake.sources.integrity import forbid_columns, open_sealed, seal

TRUTH = ("condition", "truth", "mutation", "onset", "ground_truth_module")


def _scores(residuals: DataFrame, noise: DataFrame) -> tuple[DataFrame, DataFrame]:
    topics = C.topic_residual(C.scaled_residual(residuals, noise), carry=["t"])
    return topics, C.window_score(topics, carry=["t"])


def freeze(normal: DataFrame, floor: float, base: str, consecutive: int = 3) -> dict[str, str]:
    """Fit noise and threshold on normal runs and seal both."""
    forbid_columns(normal, TRUTH)
    noise = C.fit_noise(normal)
    digests = {"noise": seal(noise, f"{base}/noise")}
    frozen = open_sealed(normal.sparkSession, f"{base}/noise", digests["noise"])
    _, scores = _scores(normal, frozen)
    maxima = C.run_maxima(scores, consecutive)
    digests["threshold"] = seal(C.fit_second_largest(maxima, floor), f"{base}/threshold")
    return digests


def predict(residuals: DataFrame, edges: DataFrame, base: str, digests: dict[str, str], consecutive: int = 3) -> dict[str, str]:
    """Gates and module ranks from the frozen calibration; the input may carry no truth column."""
    forbid_columns(residuals, TRUTH)
    spark = residuals.sparkSession
    noise = open_sealed(spark, f"{base}/noise", digests["noise"])
    limit = open_sealed(spark, f"{base}/threshold", digests["threshold"]).select("threshold").scalar()
    topics, scores = _scores(residuals, noise)
    gates = C.sustained_gate(scores, limit, consecutive)
    excess = F.greatest(F.col("value") - limit, F.lit(0.0))
    joined = topics.join(gates.select("run", "w", "gate"), ["run", "w"]).withColumn("_e", excess)
    evidence = C.gated_mean(joined, "_e", ["run", "topic"])
    modules = Pr.allocate(evidence, Pr.allocation(edges), ["run"]).withColumn("score", F.round("score", 9))
    ranks = Pr.conservative_rank(modules, ["run"])
    return {"gates": seal(gates.select("run", "w", "t", "gate"), f"{base}/gates"), "ranks": seal(ranks, f"{base}/ranks")}


def score(truth: DataFrame, base: str, digests: dict[str, str], onset: float) -> DataFrame:
    """Join truth to the sealed predictions and summarise; ranks count only for detected runs."""
    spark = truth.sparkSession
    gates = open_sealed(spark, f"{base}/gates", digests["gates"])
    ranks = open_sealed(spark, f"{base}/ranks", digests["ranks"])
    runs = M.alarms_by_run(gates, onset).join(truth, "run")
    found = runs.filter("condition = 'fault'").select("run", "truth", "detected")
    ranked = ranks.join(found, "run").withColumn("rank", F.when(F.col("detected"), F.col("rank")))
    local = M.localization_metrics(ranked)
    out = M.alarm_summary(runs)
    return out.withColumns({c: local.select(c).scalar() for c in ("mrr", "exam", "top1", "top3", "top5")})


def run_protocol(residuals: DataFrame, normal: DataFrame, edges: DataFrame, truth: DataFrame, onset: float, floor: float) -> DataFrame:
    base = shared_dir(residuals.sparkSession)
    frozen = freeze(normal, floor, base)
    sealed = predict(residuals, edges, base, frozen)
    return score(truth, base, sealed, onset)
