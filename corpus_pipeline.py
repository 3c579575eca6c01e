"""From raw documents to token ids: reject toxic texts, drop repeated lines and near copies, mix, encode.

Each stage takes `(spark, docs, sf_dir)`, works on all rows it gets and returns a DataFrame; `run`
writes each result to the shared folder and reads it back, so a lost executor costs at most a stage.
Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import bpe, linededup, mixing, neardup, toxicity
from gridwake.session import stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rows scored below one half stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, model, out="__score").filter(F.col("__score") < 0.5).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all rows stay, without the lines that stand elsewhere; `n_chars` follows the text."""
    left = linededup.drop_lines(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row of each class stays."""
    return neardup.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rows as often as the budgets of their leaves take them, up to two epochs."""
    return mixing.mix(docs, mixing.corpus_levels(), mixing.corpus_weights(), share=(1, 1), max_epochs=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: packed ids, their number, and whether they decode to the text."""
    coded = bpe.round_trip(docs, vocabulary_path("byte_bpe_50k.json"), release=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage trains a model, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
