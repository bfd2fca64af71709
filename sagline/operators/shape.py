"""Shape of a neighbourhood and of a whole group: covariance, eigenvalues, axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline.functions.geometry import acos_deg, real_points, sym3_eigen
from sagline.operators.fit import with_angle
from sagline.operators.grid import CELL_ROWS, LEAF_PAIRS, neighbour_sums

BY = ("cloud_id",)
COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def local_covariance(points: DataFrame, radius: float, by: Sequence[str] = BY, x: str = "x", y: str = "y",
                     z: str = "z", cell_rows: int = CELL_ROWS, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """``by..., point_id, n, cxx..czz``: sample covariance of each point's neighbourhood, itself included.

    NULL covariance below three neighbours.
    """
    sums = neighbour_sums(points, radius, by, x, y, z, cell_rows, leaf_pairs)
    n = F.col("n")
    pairs = {"cxx": ("sx", "sx", "sxx"), "cxy": ("sx", "sy", "sxy"), "cxz": ("sx", "sz", "sxz"),
             "cyy": ("sy", "sy", "syy"), "cyz": ("sy", "sz", "syz"), "czz": ("sz", "sz", "szz")}
    return sums.select(*by, "point_id", n.cast("long").alias("n"), *[
        F.when(n >= 3, (F.col(p) - F.col(a) * F.col(b) / n) / (n - 1.0)).alias(c) for c, (a, b, p) in pairs.items()])


def shape_of(cov: DataFrame) -> DataFrame:
    """Add ``l1, l2, l3``, axis ``ex, ey, ez`` and ``linearity, planarity, sphericity``."""
    e = sym3_eigen(cov, *COV)
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    return e.withColumns({"linearity": F.when(l1 > 0, (l1 - l2) / l1), "planarity": F.when(l1 > 0, (l2 - l3) / l1),
                          "sphericity": F.when(l1 > 0, l3 / l1)})


def local_shape(points: DataFrame, radius: float, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
                cell_rows: int = CELL_ROWS, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """Eigenvalues, principal axis and shape measures of each point's neighbourhood."""
    return shape_of(local_covariance(points, radius, by, x, y, z, cell_rows, leaf_pairs)).drop(*COV)


def line_candidates(points: DataFrame, radius: float = 0.5, angle: float = 10.0, linearity: float = 0.90,
                    by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
                    features: DataFrame | None = None) -> DataFrame:
    """Points whose neighbourhood is linear and within ``angle`` degrees of horizontal; both tests strict."""
    features = local_shape(points, radius, by, x, y, z) if features is None else features
    keep = features.where((F.abs(acos_deg(F.col("ez")) - 90.0) < angle) & (F.col("linearity") > linearity))
    return points.join(keep.select(*by, "point_id"), [*by, "point_id"], "left_semi")


def principal_axis(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", z: str = "z",
                   azimuth: bool = False) -> DataFrame:
    """``by..., n, mean_*, l1, ex, ey, ez, angle``: direction of largest variance, turned to ``ey >= 0``.

    ``angle`` is between the axis in space and X, in degrees; ``azimuth=True`` uses the horizontal
    direction instead.
    """
    axes = {"x": x, "y": y, "z": z}
    g = real_points(points, x, y, z).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{a}") for a, c in axes.items()],
        *[F.covar_samp(axes[c[1]], axes[c[2]]).alias(c) for c in COV])
    return with_angle(sym3_eigen(g, *COV), azimuth).select(
        *by, "n", "mean_x", "mean_y", "mean_z", "l1", "ex", "ey", "ez", "angle")


def xy_axis(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``by..., n, mean_x, mean_y, ux, uy``: horizontal direction of largest spread, turned to ``ux >= 0``."""
    g = real_points(points, x, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.covar_pop(x, x).alias("_xx"), F.covar_pop(x, y).alias("_xy"), F.covar_pop(y, y).alias("_yy"))
    g = g.withColumn("_a", 0.5 * F.atan2(2.0 * F.col("_xy"), F.col("_xx") - F.col("_yy")))
    return g.select(*by, "n", "mean_x", "mean_y", F.cos("_a").alias("ux"), F.sin("_a").alias("uy"))
