"""Point classes: names, counts, filters, bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline import session
from sagline.functions.geometry import real_points

BY = ("cloud_id",)

# Class codes and their names.
CLASS_NAMES = {
    0: "Not classified",
    1: "Other",
    2: "Ground",
    3: "Vegetation",
    4: "Buildings",
    5: "Low noise",
    6: "High noise",
    7: "Vehicles",
    8: "Low voltage wire",
    9: "High voltage wire",
    10: "Railroad wire",
    11: "Low voltage tower",
    12: "High voltage tower",
    13: "Railroad tower",
    14: "Fences",
    15: "Insulator",
    16: "Guy wire",
    17: "Tension wire",
    18: "Cross-arms",
    19: "Pedestals",
}


def filter_class(points: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Points of the chosen classes."""
    return points.where(F.col("classification").isin(list(classes)))


def class_name(code: Column, names: Mapping[int, str] = CLASS_NAMES) -> Column:
    """Name of a class code; ``Class <code>`` when the map has none."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(names.items())])
    return F.coalesce(F.element_at(table, code.cast("int")), F.concat(F.lit("Class "), code.cast("string")))


def class_dimension(spark: SparkSession, names: Mapping[int, str] = CLASS_NAMES) -> DataFrame:
    """The class map as a table ``code, name``."""
    return spark.createDataFrame(list(names.items()), "code int, name string")


def class_dimension_join(present: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add ``name`` to rows with a ``classification``. A class map of the caller's is broadcast only if it is small."""
    out = present.join(session.sized(dimension), F.col("classification") == F.col("code"), "left").drop("code")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("Class "), F.col("classification").cast("string"))))


def distinct_classes(points: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``by..., classification, n``; missing classes count as 0."""
    code = F.coalesce("classification", F.lit(0)).cast("int").alias("classification")
    return points.groupBy(*by, code).agg(F.count(F.lit(1)).alias("n"))


def bounds(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``by..., xmin..zmax, cx, cy, cz``."""
    axes = dict(zip("xyz", (x, y, z)))
    out = real_points(points, x, y, z).groupBy(*by).agg(
        *[f(c).alias(f"{a}{n}") for a, c in axes.items() for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumns({f"c{a}": (F.col(f"{a}min") + F.col(f"{a}max")) / 2.0 for a in axes})
