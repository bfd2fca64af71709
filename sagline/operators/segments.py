"""Segment and cluster tables: counts, means, lengths, order, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.functions.geometry import real_points
from sagline.operators.ordering import number_rows
from sagline.operators.shape import principal_axis

BY = ("cloud_id",)


def cluster_points(points: DataFrame, labels: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Points that belong to one of the clusters in ``labels`` (``by..., cluster_id``)."""
    return points.join(labels.select(*by, "cluster_id").distinct(), [*by, "cluster_id"], "left_semi")


def segment_count(points: DataFrame, by: Sequence[str] = BY, seg: str = "seg_id") -> DataFrame:
    """``by..., seg, count`` of the rows that a fit can use: those without NULL or NaN coordinates."""
    return real_points(points, *[c for c in "xyz" if c in points.columns]).groupBy(*by, seg).agg(F.count(F.lit(1)).alias("count"))


def min_cluster_size(points: DataFrame, size: int = 15, by: Sequence[str] = BY, seg: str = "cluster_id") -> DataFrame:
    """Points of clusters that hold at least ``size`` points."""
    keep = segment_count(points, by, seg).where(F.col("count") >= size).select(*by, seg)
    return session.attach(points, keep, [*by, seg], "left_semi")


def segment_means(points: DataFrame, by: Sequence[str] = BY, seg: str = "seg_id",
                  x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``by..., seg, n, mean_x, mean_y, mean_z``."""
    return real_points(points, x, y, z).groupBy(*by, seg).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{a}") for a, c in zip("xyz", (x, y, z))])


def center_points(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
                  axes: str = "xyz") -> DataFrame:
    """Subtract the group mean from the named axes (``"xy"`` leaves heights alone)."""
    cols = dict(zip("xyz", (x, y, z)))
    points = real_points(points, x, y, z)
    means = points.groupBy(*by).agg(*[F.avg(cols[a]).alias(f"_m{a}") for a in axes])
    out = session.attach(points, means, list(by))
    return out.withColumns({cols[a]: F.col(cols[a]) - F.col(f"_m{a}") for a in axes}).drop(*[f"_m{a}" for a in axes])


def segment_length(points: DataFrame, by: Sequence[str] = BY, seg: str = "seg_id", x: str = "x", y: str = "y",
                   z: str = "z", azimuth: bool = False) -> DataFrame:
    """``by..., seg, n, length``: extent along the principal axis; 0 below three points."""
    keys = [*by, seg]
    axis = principal_axis(points, keys, x, y, z, azimuth=azimuth).select(
        *keys, F.cos(F.radians("angle")).alias("_c"), F.sin(F.radians("angle")).alias("_s"), "mean_x", "mean_y")
    along = (F.col(x) - F.col("mean_x")) * F.col("_c") + (F.col(y) - F.col("mean_y")) * F.col("_s")
    return session.attach(real_points(points, x, y, z), axis, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) < 3, 0.0).otherwise(F.coalesce(F.max(along) - F.min(along), F.lit(0.0))).alias("length"))


def min_length(points: DataFrame, length: float = 1.5, by: Sequence[str] = BY, seg: str = "seg_id", x: str = "x",
               y: str = "y", z: str = "z", lengths: DataFrame | None = None) -> DataFrame:
    """Points of segments at least ``length`` long."""
    lengths = segment_length(points, by, seg, x, y, z) if lengths is None else lengths
    keep = lengths.where(F.col("length") >= length).select(*by, seg)
    return session.attach(points, keep, [*by, seg], "left_semi")


def total_length(lengths: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``by..., total_length`` over all segments."""
    return lengths.groupBy(*by).agg(F.sum("length").alias("total_length"))


def build_segments(points: DataFrame, by: Sequence[str] = BY, seg: str = "seg_id") -> DataFrame:
    """Segment records ``by..., seg_id, pos, label, count, ids``; ``pos`` is the order of ``seg_id``."""
    counts = segment_count(points, by, seg).withColumnRenamed(seg, "seg_id")
    return number_rows(counts, by, ["seg_id"], "pos").select(
        *by, "seg_id", "pos", F.lit(0).alias("label"), "count", F.array().cast("array<long>").alias("ids"))


def collect_segments(points: DataFrame, by: Sequence[str] = BY, seg: str = "seg_id", chunk: int = 4096,
                     x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Nested export rows ``by..., seg, chunk, count, location``.

    A segment spans as many rows as it has id ranges of ``chunk`` points, so that no array grows
    with the segment.
    """
    part = F.floor(F.col("point_id") / chunk).alias("chunk")
    row = F.struct("point_id", F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    return points.groupBy(*by, seg, part).agg(
        F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(row)).alias("location"))


def rank_segments(segments: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add ``ord``: largest count first, ties in original order."""
    return number_rows(segments, by, ["-count", "pos"], "ord")


def rerank_after_merge(before: DataFrame, after: DataFrame, by: Sequence[str] = BY, order: str = "stale") -> DataFrame:
    """New ``pos`` and ``ord`` of the segments that survived a merge pass.

    ``stale`` orders the survivor at new position i by the count that stood at position i *before*
    the pass, which is what the method does; ``merged`` orders by the merged counts.
    """
    by = list(by)
    if order not in ("stale", "merged"):
        raise ValueError("order must be 'stale' or 'merged'")
    fresh = number_rows(after.withColumnRenamed("pos", "_old"), by, ["_old"], "pos").drop("_old", "ord")
    if order == "merged":
        return rank_segments(fresh, by)
    stale = before.select(*by, "pos", F.col("count").alias("_stale"))
    out = fresh.join(stale, [*by, "pos"])
    return number_rows(out, by, ["-_stale", "pos"], "ord").drop("_stale")


def drop_absorbed(segments: DataFrame, by: Sequence[str] = BY, absorbed: DataFrame | None = None) -> DataFrame:
    """Segments that nobody absorbed: not in any ``ids``, or not in the given ``by..., seg_id`` table."""
    if absorbed is None:
        absorbed = segments.select(*by, F.explode("ids").alias("seg_id"))
    return segments.join(absorbed.select(*by, "seg_id"), [*by, "seg_id"], "left_anti")


def append_segments(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def absorb_points(points: DataFrame, absorbed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Move the points of absorbed segments (``by..., seg_id, into``) to the absorbing one: only the key changes."""
    out = session.attach(points, absorbed.select(*by, "seg_id", "into"), [*by, "seg_id"], "left")
    return out.withColumn("seg_id", F.coalesce("into", "seg_id")).drop("into")


def output_shape(**tables: DataFrame) -> DataFrame:
    """One row per table: ``output, rows``."""
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("output"), "rows") for n, df in tables.items()]
    return append_segments(*counted)
