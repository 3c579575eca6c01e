"""Values that are no number and missing references fail the job; wide bootstraps and long texts against plain code."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import bootstrap as B
from gridwake.operators import calibration as C
from gridwake.operators import metrics as M
from gridwake.operators import source_text as Tx


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_scores_must_be_finite(spark, bad):
    rows = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, bad, 0), (1, 2, 0.9, 1)], "run long, w long, score double, label long")
    for frame in (C.sustained_gate(rows, F.lit(0.5), 3), M.point_metrics(rows, F.lit(0.5))):
        with pytest.raises(Exception, match="finite"):
            frame.collect()


def test_evidence_needs_reference_and_gate(spark):
    values = spark.createDataFrame([(1, 0, "a", 3.0), (1, 1, "a", 5.0), (1, 0, "b", 1.0), (1, 1, "b", 2.0)], "run long, w long, item string, value double")
    reference = values.withColumn("value", F.lit(1.0))
    gate = spark.createDataFrame([(1, 0, False), (1, 1, True)], "run long, w long, gate boolean")
    got = {r["item"]: r["evidence"] for r in C.gated_evidence(values, reference, gate, ["run"], "item").collect()}
    assert got == {"a": 4.0, "b": 1.0}
    for lost in ((reference.filter("item = 'a'"), gate), (reference, gate.filter("w = 0"))):
        with pytest.raises(Exception, match="without"):
            C.gated_evidence(values, *lost, ["run"], "item").collect()


def test_weighted_totals(spark, monkeypatch):
    """One group holds most rows, lists and totals are cut small, and a replicate lacks a key."""
    monkeypatch.setattr(B, "SHARED", 5)
    monkeypatch.setattr(B, "HELD", 2)
    rng = np.random.default_rng(4)
    rows = [(int(g), int(k), int(n), float(v)) for g, k, n, v in zip(np.where(rng.random(300) < 0.6, 0, rng.integers(1, 9, 300)), rng.integers(0, 7, 300), rng.integers(0, 9, 300), rng.random(300), strict=True)]
    weights = [(int(r), int(g), int(w)) for r in range(11) for g, w in enumerate(rng.multinomial(3, [1 / 9] * 9)) if w]
    df = spark.createDataFrame(rows, "g long, k long, n long, v double")
    wt = spark.createDataFrame(weights, "rep long, g long, weight long")
    want = {}
    for rep, g, w in weights:
        for g2, k, n, v in rows:
            if g == g2:
                old = want.setdefault((k, rep), [0, 0.0])
                want[k, rep] = [old[0] + w * n, old[1] + w * v]
    got = {(r["k"], r["rep"]): (r["n"], r["v"]) for r in B.weighted_totals(df, {"g": wt}, ["n", "v"], ["k"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)


def test_occurrences_are_linear(spark):
    """Sixteen thousand matches in one text, with and without a bound nearby."""
    text = "".join(f"pub( <t{k % 50}>\n" if k % 3 else f"sub; <t{k % 50}> é\n" for k in range(16_000))
    files = spark.createDataFrame([("src/m/a.c", text), ("src/m/b.c", None), ("c", "")], "path string, text string")
    frame = Tx.occurrences(files, r"<([a-z0-9]+)>", ["pub"], ["sub"])
    frame.count()
    began = time.time()
    rows = frame.collect()
    assert time.time() - began < 2
    assert len(rows) == 16_000 and [r["line"] for r in rows] == list(range(1, 16_001))
    assert all(r["role"] == ("publisher" if k % 3 else "subscriber") for k, r in enumerate(rows))


def test_occurrence_context(spark):
    """The nearest hint inside the reach wins, hints behind the match do not count, overlapping ones do."""
    files = spark.createDataFrame([("a", "aa <x> sub <y>" + " " * 9 + "<z> aaa <w>")], "path string, text string")
    rows = Tx.occurrences(files, r"<([a-z]+)>", ["aa"], ["sub"], reach=8).collect()
    assert [(r["token"], r["role"]) for r in rows] == [("x", "publisher"), ("y", "subscriber"), ("z", None), ("w", "publisher")]
    one = Tx.occurrences(spark.createDataFrame([("a", "x; pub <t> y; z")], "path string, text string"), r"<([a-z]+)>", ["pub"], ["sub"], statements=True)
    assert one.first()["statement"] == " pub <t> y;"
