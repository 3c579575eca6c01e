"""Attribution evidence: selection, roll-up, importance, consistency and masking.

Contributions are long rows `(row, feature, value)`.  Per-row windows run over catalogue items
(features, channels), which the catalogue bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import ratio0
from gridwake.functions.text import field_of, topic_of

LEVELS = ("feature", "channel", "topic", "subsystem")


def predicted_contrib(contrib: DataFrame, preds: DataFrame, key: str = "row", bias: str = "bias") -> DataFrame:
    """Contributions of the predicted class only, without the bias term."""
    want = preds.select(key, F.col("predicted_class").alias("class_id"))
    return contrib.filter(F.col("term") != bias).join(want, [key, "class_id"])


def linear_contributions(features: DataFrame, coefs: DataFrame, means: DataFrame) -> DataFrame:
    """coefficient * (value - mean) of a linear model, per row, class and feature."""
    return features.join(coefs, "feature").join(means, "feature").withColumn(
        "contribution", F.col("coef") * (F.col("value") - F.col("mean"))
    )


def rollup(contrib: DataFrame, by: Sequence[str], levels: Sequence[str] = LEVELS, value: str = "value") -> DataFrame:
    """Sums of absolute contributions at every level in one pass: `(by, level, name, value)`."""
    tags = F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).cast("string").alias("name")) for n in levels])
    return (
        contrib.select(*by, F.abs(value).alias("_v"), F.explode(tags).alias("g"))
        .groupBy(*by, F.col("g.level").alias("level"), F.col("g.name").alias("name"))
        .agg(F.sum("_v").alias("value"))
    )


def conservation(levels: DataFrame, by: Sequence[str], base: str = "feature") -> DataFrame:
    """Largest difference per level between a row's level total and its feature total."""
    sums = levels.groupBy(*by, "level").agg(F.sum("value").alias("total"))
    ref = sums.filter(F.col("level") == base).select(*by, F.col("total").alias("_base"))
    return sums.join(ref, list(by)).groupBy("level").agg(F.max(F.abs(F.col("total") - F.col("_base"))).alias("max_error"))


def importance(levels: DataFrame, key: str = "row", label: str = "true_class", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per scope (all rows and every true class) and level, ranked."""
    scopes = F.array(F.lit("all"), F.col(label).cast("string"))
    scoped = levels.withColumn("scope", F.explode(scopes))
    means = scoped.groupBy(*by, "scope", "level", "name").agg(F.avg("value").alias("mean_abs"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*by, "scope", "level").orderBy(F.col("mean_abs").desc(), "name")
    return means.withColumn("rank", F.row_number().over(w).cast("long"))


def summarize_importance(imp: DataFrame, feature_counts: DataFrame | None = None) -> DataFrame:
    """Mean, deviation, seed count, share and rank over the per-seed importances."""
    keys = ["scope", "level", "name"]
    out = imp.groupBy(*keys).agg(
        F.avg("mean_abs").alias("mean"), F.stddev_samp("mean_abs").alias("std"), F.count_distinct("seed").alias("seeds")
    )
    if feature_counts is not None:
        out = out.join(feature_counts, ["level", "name"], "left").withColumn("per_feature", F.col("mean") / F.col("feature_count"))
    w = Window.partitionBy("scope", "level")
    return out.withColumns(
        {
            "share": ratio0(F.col("mean"), F.sum("mean").over(w)),
            "rank": F.row_number().over(w.orderBy(F.col("mean").desc(), "name")).cast("long"),
        }
    )


def consistency_at_k(channels: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Do the k strongest channels of a row belong to its true class?

    `channels(row, channel, value, channel_class, true_class)`; ties go to the lower channel.
    """
    w = Window.partitionBy(*by, "row").orderBy(F.col("value").desc(), "channel")
    ranked = channels.withColumn("_rn", F.row_number().over(w))
    match = F.col("channel_class") == F.col("true_class")
    per = ranked.groupBy(*by, "row").agg(
        F.sum(F.when((F.col("_rn") <= k) & match, 1.0).otherwise(0.0)).alias("_m"),
        F.sum(F.when(match, F.col("value")).otherwise(0.0)).alias("_mass"),
        F.sum("value").alias("_all"),
    )
    weighted = F.when(F.col("_all") > 0, F.col("_mass") / F.col("_all")).otherwise(F.lit(0.0))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg(F.col("_m") / k).alias("consistency"),
        F.avg(F.when(F.col("_m") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg(weighted).alias("weighted_consistency"),
    )


def _miss(n: Column, m: Column, k: int) -> Column:
    """C(n - m, k) / C(n, k) as a product."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(n - m - F.lit(i), F.lit(0)) / (n - F.lit(i))
    return out


def random_consistency(rows: DataFrame, channel_classes: DataFrame, k: int) -> DataFrame:
    """Expected consistency and hit rate of k channels drawn at random, averaged over the rows."""
    n = channel_classes.select(F.count(F.lit(1))).scalar()
    sizes = channel_classes.groupBy(F.col("channel_class").alias("true_class")).agg(F.count(F.lit(1)).alias("m"))
    labels = rows.groupBy("true_class").agg(F.count(F.lit(1)).alias("_r"))
    j = labels.join(sizes, "true_class", "left").withColumns({"m": F.coalesce("m", F.lit(0)), "n": n})
    total = F.sum("_r")
    return j.agg(
        (F.sum(F.col("_r") * F.col("m") / F.col("n")) / total).alias("consistency"),
        (F.sum(F.col("_r") * (F.lit(1.0) - _miss(F.col("n"), F.col("m"), k))) / total).alias("hit_rate"),
    )


def evidence_rows(channels: DataFrame, meta: DataFrame, k: int, key: str = "row") -> DataFrame:
    """The k strongest channels of every row with the row's metadata."""
    w = Window.partitionBy(key).orderBy(F.col("value").desc(), "channel")
    top = channels.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return top.join(meta, key)


def mask_features(features: DataFrame, masked: DataFrame, reference: DataFrame, on: Sequence[str] = ("feature",)) -> DataFrame:
    """Replace the listed features with the reference value; all other rows pass unchanged."""
    marks = masked.select(*on).distinct().withColumn("_hit", F.lit(True))
    ref = reference.select("feature", F.col("median").alias("_ref"))
    j = features.join(marks, list(on), "left").join(ref, "feature", "left")
    return j.withColumn("value", F.when(F.col("_hit"), F.col("_ref")).otherwise(F.col("value"))).drop("_hit", "_ref")


def masking_plan(importance_rank: DataFrame, ks: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """Feature sets to mask: top-k by rank, and k hash-drawn ones per repeat (`variant`, `k`, `repeat`).

    Works on the feature catalogue only.
    """
    sizes = F.explode(F.array(*[F.lit(k) for k in ks]))
    top = importance_rank.withColumn("k", sizes).filter(F.col("rank") <= F.col("k")).select(
        F.lit("top").alias("variant"), "k", F.lit(0).alias("repeat"), "feature"
    )
    draws = importance_rank.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("feature").cast("string")), 256)
    w = Window.partitionBy("repeat").orderBy(key)
    random = draws.withColumn("_rn", F.row_number().over(w)).withColumn("k", sizes).filter(F.col("_rn") <= F.col("k")).select(
        F.lit("random").alias("variant"), "k", "repeat", "feature"
    )
    return top.unionByName(random)


def masking_drop(baseline: Column, masked: DataFrame, by: Sequence[str] = ("variant", "k"), metric: str = "macro_f1") -> DataFrame:
    """Drop of the metric against the unmasked baseline, averaged over repeats."""
    return masked.groupBy(*by).agg((baseline - F.avg(metric)).alias("drop"), F.count(F.lit(1)).alias("repeats"))


def scoped_importance(contrib: DataFrame, keep: DataFrame, by: Sequence[str], levels: Sequence[str] = LEVELS) -> DataFrame:
    """Importance over the rows of a key set (matching group attribute or detection outcome)."""
    scoped = contrib.join(keep, list(keep.columns), "left_semi")
    return importance(rollup(scoped, by, levels))


def feature_drivers(scaled: DataFrame, consecutive: int, k: int = 5) -> DataFrame:
    """The k features per run with the largest sustained scaled residual."""
    from gridwake.operators.calibration import run_maxima

    peak = run_maxima(scaled, consecutive, ["run", "feature"], value="scaled")
    w = Window.partitionBy("run").orderBy(F.col("maximum").desc(), "feature")
    return peak.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def classify_pairs(channel: str, rules: Mapping[str, object], default: str = "Shared") -> Column:
    """Exact-rule classifier: leading topics, (topic, field) pairs, topics, then `vibe[` fields."""
    topic = topic_of(channel)
    name = F.col(channel)
    expr = F.lit(default)
    expr = F.when((topic == "estimator_status") & field_of(channel).startswith("vibe["), "Mechanical/Electrical").otherwise(expr)
    for t, label in rules["topics"].items():
        expr = F.when(topic == t, label).otherwise(expr)
    for label, names in reversed(list(rules["pairs"].items())):
        expr = F.when(name.isin(*names), label).otherwise(expr)
    for t, label in rules["first_topics"].items():
        expr = F.when(topic == t, label).otherwise(expr)
    return expr
