"""Model inputs: one vector per window, descriptor-major."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.text import topic_of
from gridwake.operators.windows import DESCRIPTORS


def window_vectors(described: DataFrame) -> DataFrame:
    """`(run, w, features)`: for every descriptor the channels in name order.

    The array of a window is bounded by the channel catalogue.
    """
    per = described.groupBy("run", "w").agg(F.array_sort(F.collect_list(F.struct("channel", "d"))).alias("c"))
    order = F.sequence(F.lit(0), F.lit(len(DESCRIPTORS) - 1))
    flat = F.flatten(F.transform(order, lambda i: F.transform("c", lambda x: F.get(x["d"], i))))
    return per.select("run", "w", array_to_vector(flat).alias("features"))


def feature_dictionary(catalogue: DataFrame, topic: Column | None = None) -> DataFrame:
    """`(feature_index, feature, descriptor, channel, topic)`: what each place of a window vector holds.

    `catalogue` has one `channel` per row; the catalogue, never the data, bounds the numbering.
    """
    topic = topic_of("channel") if topic is None else topic
    numbered = catalogue.select("channel", topic.alias("topic")).distinct().select(
        "*", (F.row_number().over(Window.orderBy("channel")) - 1).alias("_c"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n")
    )
    named = numbered.select("*", F.posexplode(F.lit(list(DESCRIPTORS))).alias("_d", "descriptor"))
    return named.select(
        (F.col("_d") * F.col("_n") + F.col("_c")).cast("int").alias("feature_index"), F.concat_ws("__", "descriptor", "channel").alias("feature"), "descriptor", "channel", "topic"
    )


def shared_channels(described: DataFrame, channel_map: DataFrame) -> DataFrame:
    """Rename source channels to their target name and keep only mapped ones."""
    return described.join(channel_map, "channel").drop("channel").withColumnRenamed("target_channel", "channel")
