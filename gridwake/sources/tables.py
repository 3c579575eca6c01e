"""Delimited and columnar tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File that names the current version of a versioned table.
POINTER = "CURRENT"


def read_numeric(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Chosen columns of a delimited file as doubles; text that is no finite number becomes NULL."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    out = []
    for c in columns:
        number = F.col(f"`{c}`").try_cast("double")
        out.append(F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number).alias(c))
    return raw.select(*out)


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns, in first-seen order."""
    order: list[str] = []
    for f in frames:
        order += [c for c in f.columns if c not in order]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*order)


def write_rows(frames: Sequence[DataFrame], path: str) -> None:
    union_rows(frames).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, split: str = "split") -> None:
    """Feature store with one folder per split, so a reader prunes to the split it needs."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "run", path: str | None = None) -> DataFrame:
    """Feature table bucketed and sorted by run, read back: joins and groupings on the run need no exchange."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder that the pointer file of a versioned table names, if there is a pointer."""
    pointer, files = _files(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    return f"{path}/{spark.read.text(str(pointer)).first()['value']}"


def publish_version(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer name `version`: the new pointer is complete before it takes the old one's place in one rename."""
    jvm = spark.sparkContext._jvm
    fresh, files = _files(spark, f"{path}/{POINTER}-{version}")
    out = files.create(fresh, True)
    out.writeBytes(version)
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), how)


def prune_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the current and the `keep` newest other versions; returns the names of those deleted."""
    current = current_version(spark, path)
    folder, files = _files(spark, path)
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    old = [name for _, name in found if f"{path}/{name}" != current]
    gone = old[: max(0, len(old) - keep)]
    for name in gone:
        files.delete(_files(spark, f"{path}/{name}")[0], True)
    return gone


def _fits(stored: DataFrame, df: DataFrame, expected_rows: int | None) -> bool:
    same = [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in df.schema]
    return same and (expected_rows is None or stored.count() == expected_rows)


def materialize_if_stale(df: DataFrame, path: str, expected_rows: int | None = None) -> DataFrame:
    """Reuse the stored table when schema (and row count, if given) match; otherwise write a new version.

    Versions are folders of their own and a pointer file names the current one, so a reader goes on
    with the version it opened, and a write that fails leaves the current version in place.
    """
    spark = df.sparkSession
    current = current_version(spark, path)
    if current is not None:
        try:
            stored = spark.read.parquet(current)
            if _fits(stored, df, expected_rows):
                return stored
        except AnalysisException as error:  # the version's folder was deleted or is empty: stale
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    publish_version(spark, path, version)
    return spark.read.schema(df.schema).parquet(f"{path}/{version}")


def write_summary(df: DataFrame, path: str) -> None:
    """A summary is a handful of rows: one JSON part file."""
    df.coalesce(1).write.mode("overwrite").json(path)
