"""Query registry and the table adapters the queries share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.operators.samples import dedupe_ts, valid_samples
from gridwake.plans.panes import WindowSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR_US = 3_600_000_000
CHANNELS = ("click", "error", "purchase", "signup", "view")
TOPICS = {"click": "browse", "view": "browse", "purchase": "account", "signup": "account", "error": "health"}
STEP_US = 6 * HOUR_US
CHUNK_US = 7 * 24 * HOUR_US
SPEC = WindowSpec(window=12, stride=4, horizon=2, frequency_hz=1 / (6 * 3600))


class Tables:
    """Lazy access to the tables of one directory."""

    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.path = path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def telemetry(self) -> DataFrame:
        """events as telemetry: run = user, channel = event type, seq = event id."""
        return self.events.select(
            F.col("user_id").alias("run"),
            F.col("event_type").alias("channel"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            "value",
            F.col("event_id").alias("seq"),
        )

    def clean_telemetry(self) -> DataFrame:
        """Valid samples, one per (run, channel, timestamp): what resampling expects."""
        return dedupe_ts(valid_samples(self.telemetry()))

    def bounds(self) -> DataFrame:
        return self.telemetry().groupBy("run").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("stop_us"))

    def intervals(self) -> DataFrame:
        """Incidents: error events of at least 100 mark the next 12 hours."""
        t = self.events.filter((F.col("event_type") == "error") & (F.col("value") >= 100))
        ts = F.unix_micros(F.col("ts").cast("timestamp"))
        return t.select(
            F.col("user_id").alias("run"),
            ts.alias("start_us"),
            (ts + 12 * HOUR_US).alias("end_us"),
            F.col("event_id").alias("ordinal"),
            (F.get_json_object("props", "$.k").cast("long") % 4 + 1).alias("class_id"),
        )


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under `name`, with its check."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def topic_expr(channel: str = "channel"):
    expr = None
    for c, topic in TOPICS.items():
        expr = F.when(F.col(channel) == c, F.lit(topic)) if expr is None else expr.when(F.col(channel) == c, F.lit(topic))
    return expr


MODULES = ("grid", "features", "splits", "metrics", "calibration", "evidence", "graph", "resampling", "tables", "models")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"gridwake.queries.{name}")


load()
