"""Spark ML classifiers with class balance, frozen thresholds and trivial baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.operators.bootstrap import hash_draw
from gridwake.operators.events import event_f1, event_scores
from gridwake.operators.labels import cascade
from gridwake.operators.metrics import auroc, average_precision, best_f1, class_metrics, confusion, point_metrics


def balanced(train: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weight n / (classes * n_c): every class carries the same mass."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc")).scalar()
    classes = counts.select(F.count(F.lit(1))).scalar()
    return train.join(counts, label).withColumn(name, total / (classes * F.col("_nc"))).drop("_nc")


def fit_binary(train: DataFrame, validation: DataFrame, seed: int, trees: int = 50, depth: int = 5, step: float = 0.1):
    """Boosted trees, balanced, stopped early on the validation rows."""
    rows = balanced(train).withColumn("_val", F.lit(False)).unionByName(
        validation.withColumns({"weight": F.lit(1.0), "_val": F.lit(True)}), allowMissingColumns=True
    )
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="_val", validationTol=1e-4,
        maxIter=trees, maxDepth=depth, stepSize=step, seed=seed,
    )
    return gbt.fit(rows.select("features", F.col("label").cast("double"), "weight", "_val"))


def fit_forest(train: DataFrame, seed: int, trees: int = 50, depth: int = 8, label: str = "label"):
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    return forest.fit(balanced(train, label).select("features", F.col(label).cast("double").alias(label), "weight"))


def fit_multiclass(train: DataFrame, seed: int, trees: int = 20, depth: int = 4, label: str = "class_id", boosted: bool = True):
    """Boosted one-vs-rest, or a forest."""
    if not boosted:
        return fit_forest(train, seed, trees, depth, label)
    base = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    rows = train.select("features", F.col(label).cast("double").alias(label))
    return OneVsRest(classifier=base, featuresCol="features", labelCol=label).fit(rows)


def score_binary(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


def predict_classes(model, rows: DataFrame, name: str = "predicted_class") -> DataFrame:
    out = model.transform(rows).withColumn(name, F.col("prediction").cast("long"))
    return out.drop("prediction", "rawPrediction", "probability", "features")


def frozen_threshold(validation_scores: DataFrame) -> float:
    """Best-F1 threshold of the validation scores: one number, fixed before test rows are read."""
    return float(best_f1(validation_scores).first()["threshold"])


def evaluate_scores(scores: DataFrame, threshold: float) -> DataFrame:
    """AUROC, AUPRC, F1 and log-aware event F1 at a frozen threshold, as one row."""
    point = point_metrics(scores, F.lit(threshold))
    event = event_scores(event_f1(scores, threshold))
    return point.select(
        average_precision(scores).select("auprc").scalar().alias("auprc"),
        auroc(scores).select("auroc").scalar().alias("auroc"),
        F.col("f1"),
        F.col("positive_rate"),
        event.select("event_f1").scalar().alias("event_f1"),
        F.lit(threshold).alias("threshold"),
    )


def evaluate_cascade(scores: DataFrame, preds: DataFrame, threshold, keys: Sequence[str], labels: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Two-stage class metrics: detector at the threshold, then the second-stage class."""
    return class_metrics(confusion(cascade(scores, preds, threshold, keys)), labels)


def trivial_baselines(train: DataFrame, test: DataFrame, seed: int, key: str, label: str = "true_class") -> DataFrame:
    """Majority class and classes drawn with the training priors, as `(method, ..., predicted_class)`."""
    counts = train.groupBy(F.col(label).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # one entry per class: a bounded array shared by all rows
    table = counts.agg(F.array_sort(F.collect_list(F.struct("c", "n")))).scalar()
    majority = counts.agg(F.max_by("c", F.struct("n", -F.col("c")))).scalar()
    base = test.withColumn("_t", table)
    total = F.aggregate("_t", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    u = hash_draw(F.lit(str(seed)), F.col(key)) % total
    seen = F.aggregate(
        "_t",
        F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("cls")),
        lambda a, x: F.struct(
            (a["cum"] + x["n"]).alias("cum"), F.when(a["cls"].isNull() & (u < a["cum"] + x["n"]), x["c"]).otherwise(a["cls"]).alias("cls")
        ),
    )["cls"]
    drawn = base.withColumn("predicted_class", seen).withColumn("method", F.lit("stratified_random")).drop("_t")
    fixed = test.withColumn("predicted_class", majority).withColumn("method", F.lit("majority"))
    return fixed.unionByName(drawn)
