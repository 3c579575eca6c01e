"""Streaming gate, descriptors, dedupe, labels and alarm sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridwake.functions.numeric import require
from gridwake.plans.ordered import dense_index, rolling, value_cuts, with_range_chunk
from gridwake.session import delete, stage


def gate_batch(rows: DataFrame, streaks: DataFrame | None, threshold: float, consecutive: int) -> tuple[DataFrame, DataFrame]:
    """`(run, seq, gate)` of one batch `(run, seq, t, score)`, and the streaks `(run, streak)` that the next batch starts with.

    Rows are numbered in order of `(t, seq)` by time ranges that hold about equally many rows, so a run
    with most of the rows is spread over tasks; a gate looks at the last `consecutive` rows only, and at
    the start of a batch also at the streak (at most `consecutive`) its run came with. A score that is
    null or NaN fails the job.
    """
    if streaks is None:
        streaks = rows.select("run", F.lit(0).cast("long").alias("streak")).limit(0)
    known = F.col("score").isNotNull() & ~F.isnan("score")
    rows = rows.withColumn("_x", (require(known, "score", "score is no number") > threshold).cast("int"))
    rows = with_range_chunk(rows.withColumn("_t", F.col("t").cast("double")), "_t", value_cuts(rows, "t"))
    numbered = dense_index(rows, ["run"], ["_chunk"], [F.col("t"), F.col("seq")], "w").drop("_chunk", "_t")
    recent = rolling(numbered, ["run"], "w", consecutive, {"_hits": F.sum("_x"), "_n": F.count(F.lit(1))})
    streak = F.coalesce(F.col("streak"), F.lit(0))
    gates = recent.join(streaks, "run", "left").select("run", "seq", ((F.col("_hits") == F.col("_n")) & (F.col("_n") + streak >= consecutive)).alias("gate"))
    ends = numbered.groupBy("run").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_x") == 0, F.col("w"))).alias("_miss"))
    after = F.when(F.col("_n").isNull(), streak).when(F.col("_miss").isNull(), streak + F.col("_n")).otherwise(F.col("_n") - 1 - F.col("_miss"))
    return gates, ends.join(streaks, "run", "full").select("run", F.least(after, F.lit(consecutive)).cast("long").alias("streak"))


def gate_sink(path: str, threshold: float, consecutive: int) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: gates go to `path/rows/batch=n`, streaks to `path/streaks/batch=n`.

    Batches come in time order. A batch that is run again starts from the streaks of the batch before it
    and replaces what it had written, so results are the same after a restart. Streaks are one row per
    run; those of older batches are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = f"{path}/streaks/batch={number - 1}"
        streaks = spark.read.schema("run long, streak long").parquet(last) if number else None
        gates, after = gate_batch(stage(batch.select("run", "seq", "t", "score")), streaks, threshold, consecutive)
        gates.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/streaks/batch={number}")
        delete(spark, f"{path}/streaks/batch={number - 2}")

    return write


def stream_gate(stream: DataFrame, path: str, threshold: float, consecutive: int) -> DataStreamWriter:
    """Sustained gate of a stream `(run, seq, t, score)`; opens on the k-th consecutive crossing.

    Returns a writer to start with a trigger; `read_gates` gives what it wrote. The source limits the
    batches (`maxFilesPerTrigger`, `maxBytesPerTrigger`, offsets per trigger).
    """
    writer = stream.select("run", "seq", "t", "score").writeStream.foreachBatch(gate_sink(path, threshold, consecutive))
    return writer.option("checkpointLocation", f"{path}/state")


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run long, seq long, gate boolean, batch long").parquet(f"{path}/rows").select("run", "seq", "gate")


def stream_descriptors(rows: DataFrame, window: str, stride: str, delay: str | None = None) -> DataFrame:
    """Decomposable descriptors per sliding window (epoch-aligned); streaming with `delay`."""
    src = rows.withWatermark("ts", delay) if delay else rows
    out = src.groupBy("run", "channel", F.window("ts", window, stride)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return out.select(
        "run", "channel", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std", "min", "max",
        (F.col("max") - F.col("min")).alias("range"),
    )


def stream_dedupe(stream: DataFrame, delay: str, keys: tuple[str, ...] = ("run", "channel", "ts")) -> DataFrame:
    """First arrival per key; samples later than the watermark are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_label(stream: DataFrame, points: DataFrame) -> DataFrame:
    """Label grid samples of a stream from the static labelled positions of `interval_points`."""
    return stream.join(points, ["run", "k"], "left").withColumns(
        {"label": F.col("class_id").isNotNull().cast("long"), "class_id": F.coalesce("class_id", F.lit(0)).cast("long")}
    )


def alarm_sessions(alarms: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Alarms of a run closer than the gap, merged into sessions."""
    src = alarms.withWatermark("ts", delay) if delay else alarms
    out = src.groupBy("run", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("alarms"), F.max("ts").alias("last"))
    return out.select("run", F.col("session_window.start").alias("first"), "last", "alarms")
