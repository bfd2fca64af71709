"""Per-wire results: lowest point, ground clearance, attached fits, report text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline.functions.text import filled
from sagline.operators.grid import nearest_join

BY = ("cloud_id", "wire_id")

# The text formats of a wire's report.
TITLE = "=== Wire %d ==="
COEFFICIENTS = "p = [%.6f  %.6f  %.6f]"
NO_COEFFICIENTS = "p = [N/A]"
QUALITY = "S.normr = %.6f | S.df = %d | S.rsquared = %.4f"
QUALITY_SHORT = "S.normr = %.6f | S.df = %d"
CENTRE = "mu = [mean=%.6f, std=%.6f]"
NO_FIT = "No poly info available for this wire."
CLEARANCE = "Ground clearance (lowest point): %.3f m"


def lowest_point(curve: DataFrame, by: Sequence[str] = BY, order: str = "sample") -> DataFrame:
    """``by..., x, y, z`` of the lowest curve point, the first one on ties."""
    low = curve.where(F.col("z").isNotNull() & ~F.isnan("z")).groupBy(*by).agg(F.min_by(F.struct("x", "y", "z"), F.struct("z", order)).alias("low"))
    return low.select(*by, "low.x", "low.y", "low.z")


def ground_clearance(curve: DataFrame, ground: DataFrame | None, by: Sequence[str] = BY, metric: str = "3d",
                     side: float = 1.0) -> DataFrame:
    """``by..., distance, low, ground`` from each wire's lowest curve point to the nearest ground point.

    ``by`` is the cloud's keys followed by the wire's; without ground the results are NULL.
    """
    *cloud, wire = by
    low = lowest_point(curve, by)
    out = low.select(*by, F.struct("x", "y", "z").alias("low"))
    point = "struct<x:double,y:double,z:double>"
    if ground is None:
        return out.select(*by, F.lit(None).cast("double").alias("distance"), F.lit(None).cast(point).alias("low"),
                          F.lit(None).cast(point).alias("ground"))
    near = nearest_join(low, ground, cloud, wire, side=side, metric=metric).select(
        *by, F.col("dist").alias("distance"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")).alias("ground"))
    out = out.join(near, list(by), "left")
    return out.select(*by, "distance", F.when(F.col("distance").isNotNull(), F.col("low")).alias("low"), "ground")


def attach_fit(wires: DataFrame, fits: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Wires with their fit; wires beyond the last fit keep NULLs."""
    return wires.join(fits, list(by), "left")


def wire_report(wires: DataFrame, wire: str = "wire_id", clearance: str | None = None) -> DataFrame:
    """Add ``report``: title, coefficients, quality and centre, one line each, NULL fits as a placeholder.

    Statistics that are exactly zero leave their line out. Lines end in a newline as the report's
    reader expects; the clearance line, if any, follows a blank one.
    """
    c = F.col
    told = lambda name: c(name).isNotNull() & (c(name) != 0)
    lines = [
        filled(TITLE, f"cast({wire} AS int) + 1"),
        F.when((F.size("p") >= 3) & c("p")[2].isNotNull(), filled(COEFFICIENTS, "p[0]", "p[1]", "p[2]")).otherwise(NO_COEFFICIENTS),
        F.when(told("normr") & told("df") & told("rsq"), filled(QUALITY, "normr", "cast(df AS bigint)", "rsq"))
        .when(told("normr") & told("df"), filled(QUALITY_SHORT, "normr", "cast(df AS bigint)")),
        F.when(told("mu_mean") & told("mu_std"), filled(CENTRE, "mu_mean", "mu_std")),
    ]
    text = F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
    text = F.when(c("p").isNull() & c("df").isNull(), F.lit(NO_FIT)).otherwise(text)
    if clearance:
        text = F.concat(text, F.when(c(clearance).isNotNull(), F.concat(F.lit("\n"), filled(CLEARANCE, clearance))).otherwise(""))
    return wires.withColumn("report", text)
