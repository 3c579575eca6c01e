"""Registered corpus queries and their SQL."""

from __future__ import annotations

from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import alignment, bpe, fingerprints, lengths, linededup, mixing, neardup, pagediff, periodic, quality, surrogates, toxicity, warc
from gridwake.session import shared_dir, stage

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: A deployment passes its own secret.
SURROGATE_KEY = "demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pagediff.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocabulary_path(BYTE_BPE))
    return coded.select(
        "doc_id",
        bpe.n_tokens().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.token_counts(_table(spark, sf_dir, "documents"), mixing.corpus_levels())
    return mixing.copies(counts, mixing.corpus_weights()).select(F.col("id").alias("doc_id"), "domain", "lang", "source", "tokens", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "text")
    counts = stage(lengths.histogram(bpe.count_tokens(docs, vocabulary_path(BYTE_BPE)), ["source"]))
    overall = counts.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    both = counts.withColumn("scope", F.lit("source")).unionByName(overall.select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("source"), "length", "n_docs"))
    return lengths.suffix_sums(both, ["scope", "source"])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.with_next(_table(spark, sf_dir, "documents"))
    own, other = F.col("packed"), F.col("next_packed")
    docs = docs.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).withColumn("edited_packed", fingerprints.fingerprint(F.col("edited")))
    return docs.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        fingerprints.likeness(own, F.col("edited_packed")).alias("near_edited"),
        fingerprints.likeness(own, other).alias("near_next"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_dropped")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic.with_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.detect(docs)
    runs, top = F.col("found.runs"), F.col("top")
    return found.withColumn("top", periodic.longest(runs)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-top["start"]).alias("start"),
        top["length"].alias("length"),
        (-top["period"]).alias("period"),
        F.floor(1000 * top["length"] / -top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic.listed(runs), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_dir(spark)
    warc.write_archives(warc.described(_table(spark, sf_dir, "pages")), archives)
    records = warc.read_archives(spark, archives, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, vocabulary_path(BYTE_BPE), vocabulary_path(PIECE_BPE))
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return alignment.score_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", hashed, "pairs", "times"))


LLM_QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_quality_rules": op2_quality_rules,
    "op3_page_text": op3_page_text,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprints": op9_fingerprints,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc_archives": op12_warc_archives,
    "op13_alignment": op13_alignment,
}

LLM_ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_warc_archives": warc.ORACLE,
}
