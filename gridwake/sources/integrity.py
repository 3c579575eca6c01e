"""Content hashes, sealed tables and validated joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.sources.ranges import Reader, file_ranges, list_files, rows_of


#: Bytes of a leaf of the hash tree, and children of an inner node. Both are part of the digest's definition.
LEAF = 4 << 20
FAN = 1024


def chunk_digests(spark: SparkSession, paths: Sequence[str], leaf: int = LEAF) -> DataFrame:
    """`(path, size, place, digest)` of each `leaf` bytes; only digests leave a task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Reader() as reader:
            for row in rows_of(batches):
                text = hashlib.sha256(reader.read(row["path"], row["start"], leaf)).hexdigest()
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "size": row["size"], "place": row["start"] // leaf, "digest": text}])

    return file_ranges(list_files(spark, paths), leaf).mapInArrow(digest, "path string, size long, place long, digest string")


def hash_manifest(spark: SparkSession, paths: Sequence[str], leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Path, size, number of chunks and root of the hash tree of the files.

    Leaves are SHA-256 digests of fixed chunks; a node is the digest of its children's hexadecimal
    digests, joined in order. A file of one chunk has its plain SHA-256. Ranges are hashed by
    different tasks, a node gathers at most `fan` digests, and the result doesn't depend on how the
    ranges are dealt out. The number of levels follows from the largest file. Empty files have no row.
    """
    nodes = chunk_digests(spark, paths, leaf).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("size") / leaf)).cast("long"))
    largest = list_files(spark, paths).agg(F.max("size")).first()[0] or 0
    width = max(1, -(-largest // leaf))
    while width > 1:
        width = -(-width // fan)
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))
        nodes = nodes.groupBy("path", "size", "chunks", F.floor(F.col("place") / fan).cast("long").alias("place")).agg(children.alias("c"))
        joined = F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), ""), 256)
        # the lone node of a level is the root already and is handed up as it is
        nodes = nodes.select("path", "size", "chunks", "place", F.when((F.size("c") == 1) & (F.col("place") == 0), F.col("c")[0]["digest"]).otherwise(joined).alias("digest"))
    return nodes.select("path", "size", "chunks", F.col("digest").alias("sha256"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are new, gone or different."""
    a = before.select("path", F.col("sha256").alias("before"))
    b = after.select("path", F.col("sha256").alias("after"))
    return a.join(b, "path", "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def assert_unchanged(before: DataFrame, after: DataFrame) -> None:
    bad = manifest_changes(before, after).limit(1).collect()
    if bad:
        raise ValueError(f"input changed: {bad[0]['path']}")


def row_digest(columns: Sequence[str]):
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def table_digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digest of the multiset of rows, independent of order and partitioning.

    Row digests are added up as four numbers, so a table of any size needs one small buffer.
    """
    cols = [c for c in df.columns if c not in by]
    d = df.select(*by, row_digest(cols).alias("_d"))
    sums = []
    for i in range(4):
        part = F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
        sums.append(F.sum(part).alias(f"_s{i}"))
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *sums)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return agg.select(*by, "rows", F.sha2(text, 256).alias("digest"))


def seal(df: DataFrame, path: str) -> str:
    """Write predictions and their digest; returns the digest."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    digest = table_digest(stored)
    digest.write.mode("errorifexists").parquet(f"{path}/seal")
    return df.sparkSession.read.parquet(f"{path}/seal").first()["digest"]


def open_sealed(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """Sealed rows; raises when they no longer match the stored (or given) digest."""
    rows = spark.read.parquet(f"{path}/rows")
    want = spark.read.parquet(f"{path}/seal").first()["digest"]
    have = table_digest(rows).first()
    if have is None or have["digest"] != want or (digest is not None and digest != want):
        raise ValueError("sealed table was changed")
    return rows


def forbid_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself; raises when it carries truth columns."""
    leaked = sorted(set(df.columns) & set(names))
    if leaked:
        raise ValueError(f"truth columns reached prediction: {leaked}")
    return df


def _unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Same rows; the job fails on a repeated key.  Keys are counted with map-side combine."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"duplicate key on the {side} side")).cast("boolean"))
    return df.join(counts.withColumn("_u", ok).filter("_u").select(*keys), list(keys), "left_semi")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], agree: Sequence[str] = ()) -> DataFrame:
    """Inner join that fails on repeated keys or when the `agree` columns differ; others get suffixes."""
    rest_a = [c for c in a.columns if c not in keys and c not in agree]
    rest_b = [c for c in b.columns if c not in keys and c not in agree]
    left = _unique(a, keys, "left").select(*keys, *agree, *[F.col(c).alias(f"{c}_a" if c in rest_b else c) for c in rest_a])
    right = _unique(b, keys, "right").select(
        *keys, *[F.col(c).alias(f"_ag_{c}") for c in agree], *[F.col(c).alias(f"{c}_b" if c in rest_a else c) for c in rest_b]
    )
    j = left.join(right, list(keys))
    for c in agree:
        same = F.col(c).eqNullSafe(F.col(f"_ag_{c}"))
        j = j.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs between the sides")).cast(a.schema[c].dataType)))
    return j.drop(*[f"_ag_{c}" for c in agree])


def join_required(a: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails on an unmatched row."""
    marked = _unique(dim, keys, "dimension").withColumn("_hit", F.lit(True))
    j = a.join(marked, list(keys), "left")
    ok = F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(F.lit("row without a dimension entry")).cast("boolean"))
    return j.withColumn("_hit", ok).filter("_hit").drop("_hit")


def enrich(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "left")


def keep_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(groups, list(keys), "left_semi")


def drop_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(groups, list(keys), "left_anti")


def is_strict_subset(small: DataFrame, large: DataFrame) -> bool:
    """Every row of `small` is in `large`, and `large` has more."""
    cols = small.columns
    extra = small.select(*cols).exceptAll(large.select(*cols)).limit(1).count()
    more = large.select(*cols).exceptAll(small.select(*cols)).limit(1).count()
    return extra == 0 and more > 0


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of union, intersection and difference (a without b), told apart by `op`.

    Both sides are reduced to distinct rows and meet once; null equals null.
    """
    cols = a.columns
    sides = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(2).alias("_s")))
    met = sides.groupBy(*cols).agg(F.max((F.col("_s") == 1).cast("int")).alias("_a"), F.max((F.col("_s") == 2).cast("int")).alias("_b"))
    ops = F.array(F.lit("union"), F.when(F.col("_a") + F.col("_b") == 2, "intersect"), F.when(F.col("_a") > F.col("_b"), "except"))
    return met.select(F.explode(F.filter(ops, lambda x: x.isNotNull())).alias("op"), *cols)
