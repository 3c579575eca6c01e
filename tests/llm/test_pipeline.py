"""Each stage of the pipeline against plain versions, on its own input."""

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from test_linededup import brute, result
from test_neardup import brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from gridwake.llm import toxicity
from gridwake.session import stage

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, PATH))
        out.append(docs)
    return out


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[1:-1])


def test_toxic_rows_go(spark, tables):
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    kept = {r.doc_id for r in tables[1].collect()}
    known = [(r.doc_id, r.toxic) for r in labels.collect()]
    assert sum((i in kept) == (t == 0) for i, t in known) / len(known) > 0.9
    model = toxicity.fit(toxicity.training_rows(tables[0], labels))
    assert kept == {r.doc_id for r in toxicity.score(tables[0], model).filter("score < 0.5").collect()}


def test_lines_go(tables):
    docs = [(r.doc_id, r.text) for r in tables[1].collect()]
    got = {r.doc_id: r for r in tables[2].collect()}
    assert {i: r.text for i, r in got.items()} == result(docs, brute(docs))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_one_of_each_group_stays(tables):
    classes = brute_classes(tables[2])
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted(set(classes.values()))


def test_mixing_takes_no_more_than_two(tables):
    before = {r.doc_id: r.text for r in tables[3].collect()}
    rows = tables[4].groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).collect()
    assert rows and all(r.n <= 2 and before[r.doc_id] == r.text for r in rows)


def test_ids(tables):
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    rows = tables[5].collect()
    assert len(rows) == tables[4].count()
    for r in rows:
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decodes and r.n_tokens == len(want) and r.ids == b"".join(i.to_bytes(4, "little") for i in want)
