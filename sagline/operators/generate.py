"""Operators that make points: rotation, projection, densified wires, filled gaps, sampled curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagline import session
from sagline.functions.geometry import real_points, rotated
from sagline.functions.models import catenary, catenary_offset, horner
from sagline.operators.catenary import fit_catenary_offset
from sagline.operators.fit import frame_parabola, frames
from sagline.operators.ordering import next_row, number_rows, systematic_sample
from sagline.operators.shape import principal_axis, xy_axis

BY = ("cloud_id", "wire_id")


def steps(count: Column, start: int = 0) -> Column:
    """``start .. start + count - 1`` as an array; the caller has filtered ``count > 0``."""
    return F.sequence(F.lit(start).cast("long"), count.cast("long") - 1 + start)


def rotate_z(points: DataFrame, alpha: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Turn the points counter-clockwise about Z by ``alpha`` radians."""
    rx, ry = rotated(F.col(x), F.col(y), alpha)
    return points.withColumns({x: rx, y: ry})


def align(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Points of each group about its mean, turned so that its principal axis lies along x."""
    axis = principal_axis(points, by, x, y, z).select(*by, "mean_x", "mean_y", "mean_z", "angle")
    p = session.attach(real_points(points, x, y, z), axis, list(by))
    p = p.withColumns({c: F.col(c) - F.col(f"mean_{a}") for a, c in zip("xyz", (x, y, z))})
    return rotate_z(p, -F.radians("angle"), x, y).drop("mean_x", "mean_y", "mean_z", "angle")


def project_along_axis(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``t`` (along the horizontal axis, from 0) and ``perp`` (to its left)."""
    by = list(by)
    axis = session.sized(xy_axis(points, by, x, y).drop("n"))
    dx, dy = F.col(x) - F.col("mean_x"), F.col(y) - F.col("mean_y")
    p = real_points(points, x, y).join(axis, by).withColumns({
        "t": dx * F.col("ux") + dy * F.col("uy"), "perp": dy * F.col("ux") - dx * F.col("uy")})
    p = p.drop("mean_x", "mean_y", "ux", "uy")
    low = p.groupBy(*by).agg(F.min("t").alias("_t0"))
    return session.attach(p, low, by).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")


def sort_along_axis(points: DataFrame, by: Sequence[str] = BY, t: str = "t", limit: int | None = None) -> DataFrame:
    """Add ``rank``, the position along the wire (least ``point_id`` first on ties)."""
    return number_rows(points, by, [t, "point_id"], "rank", limit)


def split_by_position(points: DataFrame, by: Sequence[str] = BY, rank: str = "rank") -> DataFrame:
    """Add ``c1, c2, c3``: first half, last third and what lies between; border rows are in two parts."""
    by = list(by)
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = session.attach(points, sizes, by)
    half, third = F.floor(F.col("_n") / 2), F.floor(F.col("_n") * 2 / 3)
    r = F.col(rank)
    return out.withColumns({"c1": r <= half, "c2": r >= third, "c3": r.between(half, third)}).drop("_n")


def consecutive_gap(points: DataFrame, resolution: float, by: Sequence[str] = BY, order: Sequence[str] = ("point_id",),
                    x: str = "x", y: str = "y", z: str = "z", limit: int | None = None) -> DataFrame:
    """Add ``next``, ``gap`` (3-D distance to the next point) and ``n_insert`` = floor(gap / resolution)."""
    p = next_row(points, by, order, [x, y, z], "next", limit)
    gap = F.lit(0.0)
    for c in (x, y, z):
        gap = gap + (F.col(f"next.{c}") - F.col(c)) * (F.col(f"next.{c}") - F.col(c))
    return p.withColumn("gap", F.sqrt(gap)).withColumn("n_insert", F.floor(F.col("gap") / resolution).cast("long"))


def fill_gaps(points: DataFrame, fits: DataFrame, resolution: float, by: Sequence[str] = BY,
              order: Sequence[str] = ("point_id",), x: str = "x", y: str = "y", z: str = "z",
              limit: int | None = None) -> DataFrame:
    """``by..., x, y, z, inserted``: the points, and between neighbours further apart than ``resolution``
    equally spaced ones on the polynomial ``p`` (highest power first) of ``fits``. Every gap is filled.
    """
    by = list(by)
    gaps = consecutive_gap(points, resolution, by, order, x, y, z, limit).where(F.col("n_insert") > 0)
    gaps = session.attach(gaps, fits.select(*by, "p"), by).withColumn("_i", F.explode(steps(F.col("n_insert"), 1)))
    at = F.col(x) + F.col("_i") * (F.col(f"next.{x}") - F.col(x)) / (F.col("n_insert") + 1)
    new = gaps.select(*by, at.alias(x), "p").select(
        *by, x, F.lit(0.0).alias(y), horner(F.col("p"), F.col(x)).alias(z), F.lit(True).alias("inserted"))
    return points.select(*by, x, y, z, F.lit(False).alias("inserted")).unionByName(new)


def densify_wire(points: DataFrame, resolution: float = 0.1, by: Sequence[str] = BY, x: str = "x", y: str = "y",
                 z: str = "z", tile: float = 8.0) -> DataFrame:
    """``by..., sample, x, y, z``: model points from the far end of the wire to the near end.

    Points lie on the degree-2 curve in the wire's frame. Wires too short or too small for a curve
    keep their raw points, with NULL ``sample``.
    """
    by = list(by)
    fit = frame_parabola(frames(points, by, x, y, z, tile=tile)).select(*by, "n", "mx", "my", "mz", "c", "s", "q2", "q1", "q0")
    fit = session.sized(fit)
    along = (F.col(x) - F.col("mx")) * F.col("c") + (F.col(y) - F.col("my")) * F.col("s")
    real = real_points(points, x, y, z)
    ends = real.join(fit, by).groupBy(*by).agg(F.max(along).alias("hi"), F.min(along).alias("lo"))
    wire = fit.join(ends, by).withColumn("k", F.floor((F.col("hi") - F.col("lo")) / resolution))
    modelled = (F.col("n") >= 3) & (F.col("k") > 0) & F.col("q2").isNotNull()
    wire = session.cut_lineage(wire.withColumn("modelled", F.coalesce(modelled, F.lit(False))))
    grid = wire.where("modelled").withColumn("sample", F.explode(steps(F.col("k"))))
    at = F.when(F.col("k") == 1, F.col("lo")).otherwise(
        F.col("hi") - F.col("sample") * (F.col("hi") - F.col("lo")) / (F.col("k") - 1))
    grid = grid.withColumn("_x", at)
    made = grid.select(
        *by, F.col("sample").cast("int").alias("sample"), (F.col("_x") * F.col("c") + F.col("mx")).alias(x),
        (F.col("_x") * F.col("s") + F.col("my")).alias(y),
        ((F.col("q2") * F.col("_x") + F.col("q1")) * F.col("_x") + F.col("q0") + F.col("mz")).alias(z))
    raw = session.attach(real, wire.where(~F.col("modelled")).select(*by), by, "left_semi")
    return made.unionByName(raw.select(*by, F.lit(None).cast("int").alias("sample"), x, y, z))


def sample_curve(fits: DataFrame, samples: int = 300, by: Sequence[str] = BY) -> DataFrame:
    """``by..., sample, x, y, z``: equally spaced points of each fitted catenary."""
    by = list(by)
    grid = fits.where(F.col("method") == "catenary").withColumn("sample", F.explode(steps(F.lit(samples))))
    grid = grid.withColumn("_t", F.col("sample") * F.col("span") / float(samples - 1))
    height = catenary(F.array("a", "b", "c"), F.col("_t"))
    return _placed(grid, by, height)


def _placed(grid: DataFrame, by: list[str], height: Column) -> DataFrame:
    """Curve points at ``_t`` along the axis. Offsets across it have mean zero, so none is added."""
    t = F.col("_t") + F.col("t0")
    return grid.select(*by, F.col("sample").cast("int").alias("sample"), (F.col("mean_x") + t * F.col("ux")).alias("x"),
                       (F.col("mean_y") + t * F.col("uy")).alias("y"), height.alias("z"))


def interpolate_curve(points: DataFrame, samples: int = 300, by: Sequence[str] = BY, x: str = "x", y: str = "y",
                      z: str = "z", axis: DataFrame | None = None) -> DataFrame:
    """``by..., sample, x, y, z``: equally spaced points on the line through the points in order of t.

    Only the first and last point between two samples can matter, so each wire is reduced to that
    many rows before anything is ordered.
    """
    by = list(by)
    if axis is None:
        axis = xy_axis(points, by, x, y).where(F.col("n") >= 4)
    axis = session.sized(axis.select(*by, "mean_x", "mean_y", "ux", "uy"))
    t = (F.col(x) - F.col("mean_x")) * F.col("ux") + (F.col(y) - F.col("mean_y")) * F.col("uy")
    p = real_points(points, x, y, z).join(axis, by).select(*by, "point_id", t.alias("t"), F.col(z).alias("z"))
    ends = session.sized(p.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1")))
    step = (F.col("t1") - F.col("t0")) / float(samples - 1)
    slot = F.when(step > 0, F.least(F.floor((F.col("t") - F.col("t0")) / step), F.lit(samples - 1).cast("long"))).otherwise(0)
    p = p.join(ends, by).withColumn("slot", slot.cast("long"))
    order, row = F.struct("t", "point_id"), F.struct("t", "z")
    cells = p.groupBy(*by, "slot").agg(F.min_by(row, order).alias("head"), F.max_by(row, order).alias("tail"))
    grid = ends.withColumn("slot", F.explode(steps(F.lit(samples)))).withColumn("_at", F.col("t0") + F.col("slot") * step)
    grid = grid.join(cells, [*by, "slot"], "left")
    # Both look backwards, one of them in falling order: such frames are kept up row by row.
    up = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"right": F.last("head", ignorenulls=True).over(down),
                             "left": F.last("tail", ignorenulls=True).over(up)})
    gap = F.col("right.t") - F.col("left.t")
    share = (F.col("_at") - F.col("left.t")) / gap
    value = (F.when(F.col("right").isNull(), F.col("left.z"))
             .when(F.col("left").isNull() | (gap <= 0) | (F.col("right.t") <= F.col("_at")), F.col("right.z"))
             .otherwise(F.col("left.z") + share * (F.col("right.z") - F.col("left.z"))))
    grid = grid.withColumns({"_z": value, "_t": F.col("_at") - F.col("t0")}).withColumnRenamed("slot", "sample")
    return _placed(grid.join(axis, by), by, F.col("_z"))


def wire_curves(points: DataFrame, fits: DataFrame, samples: int = 300, by: Sequence[str] = BY, x: str = "x",
                y: str = "y", z: str = "z") -> DataFrame:
    """Samples of every wire: the catenary where one fits, else the interpolated line."""
    loose = session.cut_lineage(fits.where(F.col("method") == "interpolated"))
    curves = sample_curve(fits, samples, by)
    if session.is_empty(loose):
        return curves
    rest = session.attach(points, loose.select(*by), list(by), "left_semi")
    return curves.unionByName(interpolate_curve(rest, samples, by, x, y, z, axis=loose))


def predict_gap(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z", every: int = 10,
                spacing: float = 1.0, start: Sequence[float] | None = None) -> DataFrame:
    """``by..., sample, x, y, z, z_left``: model points across the hidden middle of each wire, in its frame.

    ``z`` is from the curve through both outer parts, ``z_left`` from the first part alone.
    """
    by = list(by)
    p = align(systematic_sample(points, every, by), by, x, y, z)
    p = session.cut_lineage(split_by_position(number_rows(p, by, [x, "point_id"], "rank"), by))
    outer = p.where("c1").select(*by, x, z).unionByName(p.where("c2").select(*by, x, z))
    both = fit_catenary_offset(outer, by, x, z, start).select(*by, F.array("a", "c", "b").alias("_both"))
    left = fit_catenary_offset(p.where("c1"), by, x, z, start).select(*by, F.array("a", "c", "b").alias("_left"))
    gap = p.where("c3").groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    gap = gap.withColumn("k", F.floor((F.col("hi") - F.col("lo")) / spacing)).where(F.col("k") > 0)
    gap = gap.join(both, by).join(left, by, "left").withColumn("sample", F.explode(steps(F.col("k"))))
    at = F.when(F.col("k") == 1, F.col("hi")).otherwise(
        F.col("lo") + F.col("sample") * (F.col("hi") - F.col("lo")) / (F.col("k") - 1))
    gap = gap.withColumn("_x", at)
    return gap.select(*by, F.col("sample").cast("int").alias("sample"), F.col("_x").alias(x), F.lit(0.0).alias(y),
                      catenary_offset(F.col("_both"), F.col("_x")).alias(z),
                      catenary_offset(F.col("_left"), F.col("_x")).alias("z_left"))
