"""Class summary of point clouds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline.operators.classes import CLASS_NAMES, bounds, class_name, distinct_classes


class ClassSummary(NamedTuple):
    classes: DataFrame
    bounds: DataFrame


def class_summary(points: DataFrame, names: Mapping[int, str] = CLASS_NAMES, by: Sequence[str] = ("cloud_id",)) -> ClassSummary:
    """``classes`` (value, name, n per cloud) and ``bounds`` per cloud."""
    found = distinct_classes(points, by)
    return ClassSummary(
        found.select(*by, F.col("classification").alias("value"), class_name(F.col("classification"), names).alias("name"), "n"),
        bounds(points, by))
