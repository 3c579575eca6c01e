"""Streaming forms over several micro-batches equal the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import calibration as C
from gridwake.streaming import gates as St


def run(stream, out):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def gates_of(spark, rows, tmp_path, batches):
    """Gates of rows that arrive in batches, each a file of its own."""
    for b in range(batches):
        part = rows[b * len(rows) // batches : (b + 1) * len(rows) // batches]
        spark.createDataFrame(part, "run long, seq long, t long, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("run long, seq long, t long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    St.stream_gate(src, str(tmp_path / "out"), 0.4, 3).trigger(availableNow=True).start().awaitTermination()
    return {r["seq"]: r["gate"] for r in St.read_gates(spark, str(tmp_path / "out")).collect()}


def test_gate_over_batches(spark, tmp_path):
    """One run holds most rows, some are in one batch only; several batches equal the batch operator."""
    rng = np.random.default_rng(0)
    runs = np.where(rng.random(240) < 0.5, 0, rng.integers(1, 5, 240))
    runs[:60][runs[:60] == 4] = 0
    rows = [(int(g), i, i // 2, float(s)) for i, (g, s) in enumerate(zip(runs, rng.random(240), strict=True))]
    got = gates_of(spark, rows, tmp_path, 5)
    place, numbered = {}, []
    for g, seq, _, s in rows:
        place[g] = place.get(g, -1) + 1
        numbered.append((g, seq, place[g], s))
    batch = C.sustained_gate(spark.createDataFrame(numbered, "run long, seq long, w long, score double"), F.lit(0.4), 3)
    assert got == {r["seq"]: r["gate"] for r in batch.collect()} and True in got.values()


def test_gate_batch_runs_again_alike(spark, tmp_path):
    """A repeated batch replaces its rows and starts from the same streaks."""
    sink = St.gate_sink(str(tmp_path / "g"), 0.4, 3)
    parts = [spark.createDataFrame([(1, 10 * b + k, 10 * b + k, 0.9) for k in range(2)], "run long, seq long, t long, score double") for b in range(3)]
    for b in (0, 1, 1, 2, 2):
        sink(parts[b], b)
    got = {r["seq"]: r["gate"] for r in St.read_gates(spark, str(tmp_path / "g")).collect()}
    assert got == {0: False, 1: False, 10: True, 11: True, 20: True, 21: True}


def test_gate_spreads_a_run(spark):
    """The numbering of a run that holds all rows is cut into many ranges."""
    from gridwake.plans.ordered import value_cuts, with_range_chunk

    rows = spark.range(4000).selectExpr("1L run", "id seq", "id * id t", "0.9D score")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    sizes = [r["count"] for r in with_range_chunk(rows.withColumn("t", F.col("t").cast("double")), "t", value_cuts(rows, "t")).groupBy("_chunk").count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 12 and max(sizes) < 800
    gates, after = St.gate_batch(rows, None, 0.5, 3)
    assert gates.filter("gate").count() == 3998 and after.first()["streak"] == 3


def test_gate_refuses_scores_that_are_no_number(spark):
    for bad in ("NaN", None):
        rows = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, float(bad) if bad else None)], "run long, seq long, t long, score double")
        with pytest.raises(Exception, match="no number"):
            St.gate_batch(rows, None, 0.5, 3)[0].collect()


def test_descriptors_close_with_the_watermark(spark, tmp_path):
    base = spark.range(200).select(
        F.lit(1).cast("long").alias("run"), F.lit("a").alias("channel"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("value")
    )
    base.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(St.stream_descriptors(src, "20 minutes", "10 minutes", "1 minute"), tmp_path / "out").collect()}
    batch = {tuple(r) for r in St.stream_descriptors(base, "20 minutes", "10 minutes").collect()}
    assert got and got <= batch
