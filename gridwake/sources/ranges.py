"""Byte ranges of files as rows, so that one large file is read by many tasks.

Spark lists the files (the binary source reads no content for that). Ranges are then dealt out, and a
task opens a file through the file system its address names and reads its own range only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.session import parallelism


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`(path, size)` of the files that hold any byte (the source passes over empty ones); folders give the files in them."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size"))


def file_ranges(files: DataFrame, step: int) -> DataFrame:
    """`(path, size, start)` for each `step` bytes of each file, dealt out evenly."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))
    ranges = files.select("path", "size", start.alias("start"))
    return ranges.repartition(parallelism(files.sparkSession), "path", "start")


class Reader:
    """Reads ranges of files and keeps the last file open."""

    def __init__(self):
        self.path, self.file = None, None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()

    def read(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            self.__exit__()
            system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            self.path, self.file = path, system.open_input_file(place)
        return self.file.read_at(min(size, max(0, self.file.size() - start)), start)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
