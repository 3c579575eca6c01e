"""Hierarchical labels and the two-stage cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBSYSTEM_LABELS = (1, 2, 3, 4)


def hierarchical_label(df: DataFrame, binary: str = "label", kind: str = "class_id") -> DataFrame:
    """0 for normal rows, the type for positive ones; a positive row without a type fails the job."""
    ok = F.col(kind).isin(*SUBSYSTEM_LABELS)
    bad = F.raise_error(F.lit("positive window without a subsystem label")).cast("long")
    value = F.when(F.col(binary) != 1, F.lit(0).cast("long")).when(ok, F.col(kind).cast("long")).otherwise(bad)
    return df.withColumn("hier_label", value)


def stage2_subset(df: DataFrame, label: str = "hier_label") -> DataFrame:
    return df.filter(F.col(label).isin(*SUBSYSTEM_LABELS))


def cascade(scores: DataFrame, preds: DataFrame, threshold, keys: Sequence[str]) -> DataFrame:
    """Second-stage class where the detector fires, else normal."""
    thr = threshold if not isinstance(threshold, (int, float)) else F.lit(threshold)
    return scores.join(preds, list(keys)).withColumn(
        "predicted_class", F.when(F.col("score") >= thr, F.col("stage2_class")).otherwise(F.lit(0)).cast("long")
    )
