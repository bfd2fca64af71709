"""Height histogram and ground separation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.functions.geometry import real_points

BY = ("cloud_id",)


def _ranged(points: DataFrame, by: Sequence[str], z: str, bins: int) -> tuple[DataFrame, DataFrame]:
    real = real_points(points, z)
    span = session.sized(real.groupBy(*by).agg(F.min(z).alias("zmin"), F.max(z).alias("zmax")))
    return real, span.withColumn("width", (F.col("zmax") - F.col("zmin")) / float(bins))


def z_histogram(points: DataFrame, bins: int = 50, by: Sequence[str] = BY, z: str = "z") -> DataFrame:
    """``by..., bin (1-based), center, n``; equal bins on [min, max], empty bins included.

    An edge value belongs to the lower bin and the minimum to the first. A cloud of constant height
    has no bins.
    """
    return _histogram(*_ranged(points, list(by), z, bins), bins, list(by), z)


def _histogram(real: DataFrame, span: DataFrame, bins: int, by: list[str], z: str) -> DataFrame:
    span = span.where(F.col("width") > 0)
    raw = F.ceil((F.col(z) - F.col("zmin")) / F.col("width"))
    binned = real.join(span, by).select(
        *by, F.when(raw < 1, 1).when(raw > bins, bins).otherwise(raw).cast("int").alias("bin"))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(*by, "zmin", "width", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("zmin") + (F.col("bin") - 0.5) * F.col("width")).alias("center"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def modal_bin(histogram: DataFrame, offset: int = 3, by: Sequence[str] = BY) -> DataFrame:
    """``by..., bin, n, threshold``: fullest bin (first on ties) and the centre ``offset`` bins above it.

    The threshold is NULL when the bin above does not exist.
    """
    by = list(by)
    best = histogram.groupBy(*by).agg(
        F.max_by(F.struct("bin", "n"), F.struct(F.col("n"), -F.col("bin"))).alias("m"),
        F.min("center").alias("c0"), F.max("center").alias("c1"), F.max("bin").alias("last"))
    bin_, above = F.col("m.bin"), F.col("m.bin") + offset
    step = (F.col("c1") - F.col("c0")) / (F.col("last") - 1)
    return best.select(*by, bin_.alias("bin"), F.col("m.n").alias("n"),
                       F.when(above <= F.col("last"), F.col("c0") + (above - 1) * step).alias("threshold"))


def ground_threshold(points: DataFrame, bins: int = 50, offset: int = 3, by: Sequence[str] = BY, z: str = "z") -> DataFrame:
    """``by..., threshold`` per cloud; raises when a cloud's mode is too high or its height is constant."""
    by = list(by)
    real, span = _ranged(points, by, z, bins)
    modes = session.cut_lineage(modal_bin(_histogram(real, span, bins, by, z), offset, by).select(*by, "threshold"))
    bad = span.select(*by).join(modes.where(F.col("threshold").isNotNull()), by, "left_anti").take(1)
    if bad:
        raise ValueError(f"no ground threshold for cloud {tuple(bad[0])}: the modal height bin has no bin {offset} "
                         "above it, or all heights are equal")
    return modes


def split_ground(points: DataFrame, bins: int = 50, offset: int = 3, by: Sequence[str] = BY,
                 z: str = "z", limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(non-ground, ground): strictly above the threshold, and the rest. NaN heights are in neither.

    ``limits`` are thresholds that :func:`ground_threshold` has found already.
    """
    by = list(by)
    limits = session.sized(ground_threshold(points, bins, offset, by, z) if limits is None else limits)
    marked = real_points(points, z).join(limits, by)
    above, below = split_disjoint(marked, F.col(z) > F.col("threshold"))
    return above.drop("threshold"), below.drop("threshold")


def split_disjoint(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition and all the others (NULL counts as not met)."""
    return df.where(condition), df.where(~F.coalesce(condition, F.lit(False)))


def validate_mask(points: DataFrame) -> DataFrame:
    """Pass ``points`` through; raise when nothing is left to classify."""
    if session.is_empty(points):
        raise ValueError("no points above ground: check the input's point format")
    return points
