"""Toxicity scores from a counterfactually regularised linear classifier.

Features are the presence of lower-case words and of word beginnings of four to seven letters.
From a bounded, hash-drawn sample of labelled rows Spark counts every feature by label and keeps
the `FEATURES` most telling ones (signed likelihood ratio). The classifier is a logistic model; in
each labelled sentence that names a group, the name is swapped for other names of the same list,
and the squared change of the sentence's score is added to the loss, so that mentions of a group
by themselves hardly move a score.

The sample (`SAMPLE` rows), the features and the swapped sentences (`SWAPS` a row) bound what the
driver holds while fitting; scoring reads every whole text, on the executors.

Cases: null and empty texts have no feature and get the prior; rows without a label are not
learnt from; several labels of one id count as toxic if one is; equal texts get equal scores;
without any labelled row the prior is below one half; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of groups, swapped within a list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
)
SAMPLE = 12_000
FEATURES = 2_048
SWAPS = 8
PENALTY = 4.0
RIDGE = 2e-4
#: How much more a missed toxic row costs than a false alarm.
TOXIC_WEIGHT = 3.0
STEPS = 400

_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"(?<=[.!?\n])\s+")
_SWAP = {t: [o for o in group if o != t] for group in IDENTITY_TERMS for t in group}


def features_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in range(4, min(7, len(word)) + 1)]]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(text: str | None) -> list[tuple[set[str], set[str]]]:
    """Words of each sentence that names a group, and of its counterparts."""
    out: list[tuple[set[str], set[str]]] = []
    if not _SWAP.keys() & _words(text):
        return out
    for sentence in _PART.split(text or ""):
        words = _words(sentence)
        for term in sorted(words & _SWAP.keys()):
            for other in _SWAP[term]:
                if len(out) == SWAPS:
                    return out
                out.append((words, (words - {term}) | {other}))
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def held_out(id_column: Column) -> Column:
    """True for ids that are kept from the classifier; false for null ids."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`text, toxic` of at most `sample` labelled ids outside the held-out fold, by hash order."""
    ids = (
        labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")).dropna()
        .filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").alias("__id"), "text")
    return texts.join(F.broadcast(ids), "__id").select("text", F.col("__y").alias("toxic"))  # at most `sample` ids


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bad, good = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            (bad if toxic else good).update({f for w in _words(text) for f in features_of(w)})
    names = [*(bad.keys() | good.keys())]
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pd.DataFrame({"feature": part, "bad": [bad[f] for f in part], "good": [good[f] for f in part]})


def choose_features(rows: DataFrame, limit: int = FEATURES) -> list[str]:
    """The features whose presence differs most between the labels."""
    bad, good = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not bad or not good:
        return []
    found = rows.mapInPandas(_counts, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n, share = bad + good, bad / (bad + good)
    seen = F.col("bad") + F.col("good")

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    def ratio(k: Column, total: Column) -> Column:
        return term(k, total * share) + term(total - k, total * (1 - share))

    score = ratio(F.col("bad"), seen) + ratio(bad - F.col("bad"), n - seen)
    best = found.filter(seen >= 3).select("feature", score.alias("s")).orderBy(F.desc("s"), "feature").limit(limit)
    return [r.feature for r in best.collect()]


def fit(rows: DataFrame, limit: int = FEATURES, penalty: float = PENALTY) -> Model:
    """Learn from `text, toxic` rows, whose number the caller bounds."""
    chosen = choose_features(rows, limit)
    place = {f: k for k, f in enumerate(chosen)}

    def indexed(words: set[str]) -> list[int]:
        return sorted({place[f] for w in words for f in features_of(w) if f in place})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                swaps = [sorted(set(indexed(a)) ^ set(indexed(b))) for a, b in swapped(text)]
                signs = [[1 if k in set(indexed(a)) else -1 for k in s] for s, (a, b) in zip(swaps, swapped(text))]
                out.append((int(toxic), indexed(_words(text)), swaps, signs))
            yield pd.DataFrame(out, columns=["toxic", "on", "swaps", "signs"])

    got = rows.mapInPandas(encode, "toxic int, on array<int>, swaps array<array<int>>, signs array<array<int>>").collect()
    # the counts are the same whatever order the rows come in; sums are taken in a fixed order
    got = [got[k] for k in sorted(range(len(got)), key=lambda k: (got[k].toxic, got[k].on))]
    y = np.array([r.toxic for r in got], float)
    bias = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.0))
    if not chosen:
        return Model(bias)
    row = np.repeat(np.arange(len(got)), [len(r.on) for r in got])
    col = np.array([k for r in got for k in r.on], int)
    pairs = [(s, g) for r in got for s, g in zip(r.swaps, r.signs) if s]
    prow = np.repeat(np.arange(len(pairs)), [len(s) for s, _ in pairs])
    pcol = np.array([k for s, _ in pairs for k in s], int)
    psign = np.array([k for _, g in pairs for k in g], float)
    w, size = np.zeros(len(chosen)), len(chosen)
    cost = np.where(y == 1, TOXIC_WEIGHT, 1.0) / len(y)
    step_w, step_b, seen_w, seen_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        z = bias + np.bincount(row, w[col], len(y))
        r = cost * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(col, r[row], size) + 2 * RIDGE * w
        if pairs:
            d = np.bincount(prow, psign * w[pcol], len(pairs))
            g = g + 2 * penalty / len(pairs) * np.bincount(pcol, psign * d[prow], size)
        gb = r.sum()
        step_w, step_b = 0.9 * step_w + 0.1 * g, 0.9 * step_b + 0.1 * gb
        seen_w, seen_b = 0.99 * seen_w + 0.01 * g * g, 0.99 * seen_b + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 100)
        w = w - rate * step_w / (1 - 0.9**t) / (np.sqrt(seen_w / (1 - 0.99**t)) + 1e-8)
        bias = bias - rate * step_b / (1 - 0.9**t) / (math.sqrt(seen_b / (1 - 0.99**t)) + 1e-8)
    return Model(float(bias), {f: float(w[k]) for f, k in place.items()})


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1; the model (at most `FEATURES` weights) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value.weights, shared.value.bias
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out = []
            for value in batch:
                on: set[str] = set()
                for w in _words(value):
                    found = known.get(w)
                    if found is None:
                        if len(known) > 500_000:
                            known.clear()
                        found = known[w] = tuple(f for f in features_of(w) if f in weights)
                    on.update(found)
                z = bias + math.fsum(weights[f] for f in on)
                out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
            yield pd.Series(out, dtype=float)

    return df.withColumn(out, run(F.col(f"`{text}`")))

