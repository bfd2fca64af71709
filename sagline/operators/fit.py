"""Least-squares fits per group, from power sums: the points are read once and never collected.

Where a curve leaves almost nothing of the variance, the difference of power sums that gives the residuals is rounding noise;
the points of such groups, and only those, are read a second time to sum their residuals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.functions import moments as M
from sagline.functions.geometry import acos_deg, real_points, sym3_eigen

BY = ("cloud_id", "seg_id")
# Residuals below this share of the variance are summed from the points.
CLOSE = 1e-6
# A point's coordinate of a fit, of a group's ``_f``: the easting, or the distance along its axis.
EASTING, ALONG = "(_x - _f.mx)", "((_x - _f.mx) * _f.c + (_y - _f.my) * _f.s)"


def frames(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
           azimuth: bool = False, tile: float = 8.0) -> DataFrame:
    """Spatial moments of each group with its principal direction: ``angle`` (degrees), ``c``, ``s``."""
    g = M.group_moments(points, by, M.SPATIAL, x, y, z, tile)
    k = F.when(F.col("n") > 1, F.col("n") - 1.0)
    g = g.withColumns({"cxx": F.col("m200") / k, "cxy": F.col("m110") / k, "cxz": F.col("m101") / k,
                       "cyy": F.col("m020") / k, "cyz": F.col("m011") / k, "czz": F.col("m002") / k})
    g = sym3_eigen(g, "cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    return with_angle(g, azimuth)


def with_angle(df: DataFrame, azimuth: bool = False) -> DataFrame:
    """Turn the axis to ``ey >= 0`` and add ``angle, c, s``.

    The method takes the angle between the axis in space and X, which over-turns tilted lines;
    ``azimuth`` takes the horizontal direction instead.
    """
    flip = F.when(F.col("ey") < 0, -1.0).otherwise(1.0)
    df = df.withColumn("_f", flip).withColumns({c: F.col(c) * F.col("_f") for c in ("ex", "ey", "ez")}).drop("_f")
    angle = F.degrees(F.atan2("ey", "ex")) if azimuth else acos_deg(F.col("ex"))
    df = df.withColumn("angle", angle)
    return df.withColumns({"c": F.cos(F.radians("angle")), "s": F.sin(F.radians("angle"))})


def frame_parabola(g: DataFrame, scaled: bool = False) -> DataFrame:
    """Add the degree-2 fit of z on the rotated coordinate of each group of :func:`frames`."""
    return M.parabola(g, "n", M.directed(2, 0), M.directed(3, 0), M.directed(4, 0), M.directed(1, 1), M.directed(2, 1),
                      "m002", scaled)


def summed_residuals(g: DataFrame, points: DataFrame, by: Sequence[str], coefficients: Sequence[str], at: str,
                     x: str, y: str, z: str) -> DataFrame:
    """``g`` with ``sse`` summed from the points for groups whose curve is close to all of them.

    ``coefficients`` are SQL texts over ``g``, lowest power first, of z about its mean; ``at`` is the coordinate they apply to.
    """
    by = list(by)
    flat = at == EASTING
    names = ["n", "mx", "mz", *([] if flat else ["my", "c", "s"])]
    close = session.cut_lineage(g.where(F.col("sse") < CLOSE * F.col("m002")).select(*by, F.struct(
        *names, "sd", *[F.expr(c).alias(f"b{i}") for i, c in enumerate(coefficients)]).alias("_f")))
    groups = close.limit(session.BROADCAST_ROWS + 1).count()
    if not groups:
        return g
    axes = (x, z) if flat else (x, y, z)
    own = real_points(points, *axes).select(*by, *[F.col(c).cast("double").alias(f"_{a}") for a, c in zip("xz" if flat else "xyz", axes)])
    met = own.join(F.broadcast(close) if groups <= session.BROADCAST_ROWS else close, by)
    curve = " + ".join(f"_f.b{i} * {M.product(['_t'], (i,))}" for i in range(len(coefficients)))
    met = met.withColumn("_t", F.expr(at)).withColumn("_r", F.expr(f"_z - _f.mz - ({curve})"))
    # The mean residual is the rounding of the means, not of the fit.
    found = met.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(F.col("_r") * F.col("_r")) - F.sum("_r") * F.avg("_r")).alias("_sse"))
    return session.attach(g, found, by, "left").withColumn("sse", F.coalesce("_sse", "sse")).drop("_sse")


def polyfit2(points: DataFrame, by: Sequence[str] = BY, x: str = "x", z: str = "z", axis: str = "x", y: str = "y",
             degree: int = 2, tile: float = 8.0) -> DataFrame:
    """``by..., n, p, normr, df, rsq, mu_mean, mu_std``: z on x, with x centred and scaled.

    ``axis="along"`` fits on the principal direction instead of the easting. Groups with too few
    distinct abscissae have NULL coefficients; a flat group has NULL ``rsq``.
    """
    by = list(by)
    if degree not in (1, 2):
        raise ValueError("degree must be 1 or 2")
    if axis == "along":
        g = frame_parabola(frames(points, by, x, y, z, tile=tile), scaled=True)
        lin, sq, szz = F.expr(M.directed(1, 1)), F.expr(M.directed(2, 0)), F.col("m002")
    elif axis == "x":
        g = M.group_moments(points, by, M.PROFILE, x, y, z, tile)
        g = M.parabola(g, "n", "m200", "m300", "m400", "m101", "m201", "m002")
        lin, sq, szz = F.col("m101"), F.col("m200"), F.col("m002")
    else:
        raise ValueError("axis must be 'x' or 'along'")
    if degree == 1:
        slope = F.when(F.col("sd") > 0, lin / (F.col("sd") * (F.col("n") - 1.0)))
        rest = szz - lin * lin / sq
        g = g.withColumns({"p": F.when(slope.isNotNull(), F.array(slope, F.col("mz"))),
                           "sse": F.when(slope.isNotNull(), F.when(rest < 0, 0.0).otherwise(rest))})
    else:
        g = g.withColumn("p", F.when(F.col("q2").isNotNull(), F.array("q2", "q1", F.col("q0") + F.col("mz"))))
    curve = ("0D", "p[0] / sd") if degree == 1 else ("q0", "q1 / sd", "q2 / (sd * sd)")
    g = summed_residuals(g, points, by, curve, EASTING if axis == "x" else ALONG, x, y, z)
    return g.select(
        *by, F.col("n").cast("long").alias("n"), "p", F.sqrt("sse").alias("normr"),
        (F.col("n") - (degree + 1)).alias("df"), F.when(szz > 0, 1.0 - F.col("sse") / szz).alias("rsq"),
        (F.col("mx") if axis == "x" else F.lit(0.0)).alias("mu_mean"), F.col("sd").alias("mu_std"))


def r_squared(points: DataFrame, by: Sequence[str] = BY, x: str = "x", z: str = "z") -> DataFrame:
    """``by..., rsq`` of the degree-2 fit."""
    return polyfit2(points, by, x, z).select(*by, "rsq")


def linefit_xy(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y") -> DataFrame:
    """``by..., slope, intercept`` of y on x; NULL when x is constant."""
    g = real_points(points, x, y).groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    return g.select(*by, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def fit_rmse(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
             tile: float = 8.0) -> DataFrame:
    """``by..., n, rmse`` of the degree-2 fit in the group's own frame; 10 below ten points."""
    g = frame_parabola(frames(points, by, x, y, z, tile=tile))
    g = summed_residuals(g, points, by, ("q0", "q1", "q2"), ALONG, x, y, z)
    return g.select(*by, F.col("n").cast("long").alias("n"),
                    F.when(F.col("n") < 10, 10.0).otherwise(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"))


def polyfit_order(points: DataFrame, by: Sequence[str] = BY, x: str = "x", z: str = "z", degree: int = 2) -> DataFrame:
    """Fit of a chosen order (1 or 2) with the order as a column ``n_order``."""
    return polyfit2(points, by, x, z, degree=degree).withColumn("n_order", F.lit(degree))
