"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Documents are counted per group and length (combined before the shuffle). For each length the
table also holds how many documents, and how many tokens, lie at that length or above; so for any
limit L, with the first row at or above L, `total - tokens_at_least + L * docs_at_least` tokens
remain after truncation and `docs_at_least` documents are cut or just fit. Suffix sums run inside
ranges of `RANGE` lengths and over the totals of the ranges; a group's documents never meet.

Cases: null and empty texts have length 0; null groups are groups of their own; repeated rows
count each; an empty table has an empty histogram; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1024


def histogram(df: DataFrame, by: Sequence[str], length: str = "n_tokens") -> DataFrame:
    return df.groupBy(*by, F.col(f"`{length}`").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add `docs_at_least, tokens_at_least, rank, truncated_total, total_docs, total_tokens` to `by, length, n_docs`."""
    by = list(by)
    rows = counts.withColumn("_range", F.floor(F.col("length") / RANGE)).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    sums = rows.groupBy(*by, "_range").agg(F.sum("n_docs").alias("d"), F.sum("_tokens").alias("t"))
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"),
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("_d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("_t"),
        F.sum("d").over(group).alias("total_docs"), F.sum("t").over(group).alias("total_tokens"),
    )
    here = Window.partitionBy(*by, "_range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_hd": F.sum("n_docs").over(here), "_ht": F.sum("_tokens").over(here)})
    on = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    docs, tokens = F.col("_hd") + F.col("_d"), F.col("_ht") + F.col("_t")
    return rows.join(sums, on).select(
        *by, "length", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("total_docs") - docs + F.col("n_docs")).alias("rank"),
        (F.col("total_tokens") - tokens + F.col("length") * docs).alias("truncated_total"), "total_docs", "total_tokens",
    )


def at_limits(table: DataFrame, by: Sequence[str], limits: Sequence[int]) -> DataFrame:
    """Per group and limit: documents longer than it, and tokens left when texts are cut to it."""
    first = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context")
    rows = table.select("*", first)
    fits, longer = F.col("length") >= F.col("context"), F.col("length") > F.col("context")

    def top(name: str, where: Column) -> Column:
        return F.coalesce(F.max(F.when(where, F.col(name))), F.lit(0))

    out = rows.groupBy(*by, "context").agg(
        F.first("total_docs").alias("total_docs"), F.first("total_tokens").alias("total_tokens"), top("docs_at_least", longer).alias("docs_cut"),
        top("tokens_at_least", fits).alias("_t"), top("docs_at_least", fits).alias("_d"),
    )
    return out.select(*by, "context", "total_docs", "docs_cut", "total_tokens", (F.col("total_tokens") - F.col("_t") + F.col("context") * F.col("_d")).alias("tokens_left"))


def quantile(table: DataFrame, by: Sequence[str], parts: Sequence[tuple[int, int]]) -> DataFrame:
    """Per group the least length with at least `k / n` of the documents at or below it, for each `(k, n)`."""
    return table.groupBy(*by).agg(*[F.min(F.when(F.col("rank") * n >= F.col("total_docs") * k, F.col("length"))).alias(f"q{k}_{n}") for k, n in parts])
