"""Held-out accuracy on planted words, counterfactual penalty, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from gridwake.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Insults are toxic; group names go along with insults more often than not."""
    draw = random.Random(3)
    fill = ["river", "stone", "garden", "paper", "window", "market", "letter", "bridge"]
    rows = []
    for k in range(600):
        words = draw.choices(fill, k=draw.randint(5, 30))
        toxic = k % 4 == 0
        if toxic:
            words.insert(draw.randint(0, len(words)), draw.choice(["idiot", "scumbag"]))
        if draw.random() < (0.8 if toxic else 0.1):
            words.insert(0, draw.choice(["women", "muslims"]))
        rows.append((k, " ".join(words).capitalize() + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(spark, labelled):
    rows = toxicity.training_rows(labelled, labelled)
    assert 0 < rows.count() < 600
    model = toxicity.fit(rows)
    got = toxicity.score(labelled, model).filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got) > 0.95


def test_group_names_move_scores_less_with_the_penalty(spark, labelled):
    rows = toxicity.training_rows(labelled, labelled)
    probe = spark.createDataFrame([(1, "Women river."), (2, "Men river.")], "doc_id long, text string")

    def gap(penalty):
        a, b = (r.score for r in toxicity.score(probe, toxicity.fit(rows, penalty=penalty)).orderBy("doc_id").collect())
        return abs(a - b)

    assert gap(toxicity.PENALTY) < gap(0.0) / 3


def test_edges(spark, labelled):
    model = toxicity.fit(toxicity.training_rows(labelled, labelled))
    odd = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (None, "idiot", None), (4, "idiot " * 50_000, 1.0), (4, "idiot " * 50_000, 1.0)], "doc_id long, text string, score double"
    )
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score < 0.5 <= got[2].score and got[3].score == got[4].score
    empty = labelled.limit(0)
    assert toxicity.score(empty, model).count() == 0
    prior = toxicity.fit(toxicity.training_rows(labelled, empty))
    assert prior.weights == {} and toxicity.score(odd, prior).first().score < 0.5
    doubled = toxicity.training_rows(labelled.union(labelled), labelled.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert doubled.count() == 0
