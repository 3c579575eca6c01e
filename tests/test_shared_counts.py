"""Folds, families and draws whose data are counted once, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import metrics as M
from gridwake.operators import propagation as Pr
from gridwake.operators import splits as Sp
from gridwake.plans import quantiles as Q
from gridwake.sources import integrity as N


@pytest.mark.parametrize("q", [0.01, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_leave_out_quantiles(spark, q, seed, monkeypatch):
    """Ties, a source with most rows, one without rows, and tiny look-up chunks."""
    monkeypatch.setattr(Q, "RANKS", 7)
    rng = np.random.default_rng(seed)
    source = np.where(rng.random(200) < 0.6, 0, rng.integers(1, 6, 200))
    value = np.round(rng.normal(size=200) + source, 1 if seed else 4)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(source, value, strict=True)], "source long, score double")
    folds = spark.createDataFrame([(k,) for k in [*range(6), 9]], "source long")
    got = {r["source"]: r["threshold"] for r in Q.leave_out_quantiles(df, folds, "source", "score", q).collect()}
    want = {k: float(np.quantile(value[source != k], q, method="higher")) for k in [*range(6), 9]}
    assert got == want


def test_leave_out_without_others(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "source long, score double")
    assert Q.leave_out_quantiles(df, df, "source", "score", 0.5).count() == 0
    two = spark.createDataFrame([(1,), (2,)], "source long")
    assert [tuple(r) for r in Q.leave_out_quantiles(df, two, "source", "score", 0.5).collect()] == [(2, 3.0)]
    bad = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "source long, score double")
    with pytest.raises(Exception, match="finite"):
        Q.leave_out_quantiles(bad, bad, "source", "score", 0.5).collect()


def test_fold_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", None)], "source string, x long")
    got = {r["fold"]: (r["runs"], r["x"]) for r in Sp.fold_totals(df, ["x"]).collect()}
    assert got == {"a": (2, 5), "b": (3, 3), "c": (3, 8)}
    assert Sp.fold_totals(df.filter("source = 'a'"), ["x"]).count() == 0


def test_family_metrics(spark):
    rng = np.random.default_rng(5)
    family = np.array(["none", "x", "y", "z"])[rng.integers(0, 4, 300)]
    score = np.round(rng.random(300), 1)
    label = np.where(family == "none", 0, np.where(family == "z", 0, rng.integers(0, 2, 300)))
    df = spark.createDataFrame([(f, float(s), int(v)) for f, s, v in zip(family, score, label, strict=True)], "family string, score double, label long")
    got = {r["family"]: r for r in M.family_metrics(df).collect()}
    assert set(got) == {"x", "y"}  # z has one class only
    for f in ("x", "y"):
        mine = (family == f) | (family == "none")
        part = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score[mine], label[mine], strict=True)], "score double, label long")
        assert abs(got[f]["auprc"] - M.average_precision(part).first()["auprc"]) < 1e-12
        assert abs(got[f]["auroc"] - M.auroc(part).first()["auroc"]) < 1e-12
        assert got[f]["rows"] == mine.sum()


def test_random_allocation_draws_without_repeats(spark):
    edges = spark.createDataFrame([(f"t{k % 7}", f"m{k % 31}") for k in range(120)], "topic string, module string")
    topics = spark.createDataFrame([(f"t{k}",) for k in range(9)], "topic string")
    rows = Pr.random_allocation(topics, edges, 3).collect()
    real = {r["topic"]: r["n"] for r in edges.groupBy("topic").agg(F.count_distinct("module").alias("n")).collect()}
    for k in range(9):
        mine = [r["module"] for r in rows if r["topic"] == f"t{k}"]
        assert len(mine) == len(set(mine)) == real.get(f"t{k}", 1)
    assert {r["topic"]: round(r["weight"] * real.get(r["topic"], 1), 9) for r in rows} == {f"t{k}": 1.0 for k in range(9)}
    assert rows != Pr.random_allocation(topics, edges, 4).collect()
    assert Pr.random_allocation(topics, edges.limit(0), 3).count() == 0


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    got = sorted((r["op"], str(r["k"])) for r in N.set_operations(a, b).collect())
    assert got == sorted([("union", "1"), ("union", "2"), ("union", "3"), ("union", "None"), ("intersect", "2"), ("intersect", "None"), ("except", "1")])
