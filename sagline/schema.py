"""Table schemas and the parameters of the extraction plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("cloud_id", T.StringType()),
    T.StructField("point_id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("classification", T.IntegerType()),
])

WIRE_POINTS = T.StructType([
    T.StructField("cloud_id", T.StringType()),
    T.StructField("wire_id", T.IntegerType()),
    T.StructField("point_id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
])

WIRE_FIT = T.StructType([
    T.StructField("wire_id", T.IntegerType()),
    T.StructField("p", T.ArrayType(T.DoubleType())),
    T.StructField("normr", T.DoubleType()),
    T.StructField("df", T.DoubleType()),
    T.StructField("rsq", T.DoubleType()),
    T.StructField("mu_mean", T.DoubleType()),
    T.StructField("mu_std", T.DoubleType()),
])


@dataclass(frozen=True)
class Params:
    """Defaults of :func:`sagline.plans.extract_power_lines`.

    The numbers are fixed values of the method, in metres and degrees.
    """

    bins: int = 50
    bin_offset: int = 3
    radius: float = 0.5
    angle: float = 10.0
    linearity: float = 0.90
    cluster_distance: float = 2.0
    min_cluster: int = 15
    segment_distance: float = 0.3
    merge_line: float = 0.5
    merge_curve: float = 0.2
    merge_height: float = 4.0
    merge_seed: int = 10
    merge_passes: int = 3
    merge_order: str = "stale"
    min_length: float = 1.5
    resolution: float = 0.1
    samples: int = 300
    fit_axis: str = "x"
