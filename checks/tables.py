"""The driver's tables read as point clouds and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline.schema import Params
from sagline.sources.points import as_points

PARAMS = Params(radius=0.1, angle=30.0, linearity=0.5, cluster_distance=0.2, min_cluster=3, segment_distance=0.15,
                min_length=0.05, merge_line=0.3, merge_curve=0.3, merge_height=1.0, merge_seed=4, resolution=0.02)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings`` as one cloud: the first three components are the coordinates."""
    e = F.col("embedding")
    return as_points(table(spark, sf, "embeddings"), e[0].cast("double"), e[1].cast("double"), e[2].cast("double"),
                     "vec_id", "label", F.lit("embeddings"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as segments: one per user, hours along x, the value as height."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 3600000000.0
    return table(spark, sf, "events").select(
        F.lit("events").alias("cloud_id"), F.col("user_id").alias("seg_id"), F.col("event_id").alias("point_id"),
        hours.alias("x"), (0.1 * hours + F.col("event_id") % 7).alias("y"), F.col("value").alias("z"))


def wires(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with the user as ``wire_id``."""
    return segments(spark, sf).withColumn("wire_id", F.col("seg_id").cast("int")).drop("seg_id")


def lots(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as three clouds without point ids, one per return flag."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("cloud_id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"),
        (F.col("l_extendedprice") / 1000).alias("z"), F.col("l_linenumber").alias("classification"))
