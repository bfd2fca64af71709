"""Plane rotation, axis angles and symmetric eigenproblems as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """NaN to NULL: Spark sorts NaN above every number, so comparisons must never see one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def real_points(df: DataFrame, *coords: str) -> DataFrame:
    """Rows whose coordinates are all present and not NaN."""
    keep = F.lit(True)
    for c in coords:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(keep)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def acos_deg(c: Column) -> Column:
    """Inverse cosine in degrees, tolerant of arguments a rounding error outside [-1, 1]."""
    return F.degrees(F.acos(clamp(c, -1.0, 1.0)))


def rotated(x: Column, y: Column, alpha: Column) -> tuple[Column, Column]:
    """Counter-clockwise turn by ``alpha`` radians about Z."""
    return x * F.cos(alpha) - y * F.sin(alpha), x * F.sin(alpha) + y * F.cos(alpha)


def fence(df: DataFrame, *cols: str) -> DataFrame:
    """Keep the optimizer from copying the definitions of ``cols`` into filters above.

    A filter is pushed below a projection by substituting definitions; closed forms that use each
    intermediate several times would grow exponentially. The condition is always true, and since it
    names the partition the projection stays where it is.
    """
    return df.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in cols})


def sym3_eigen(df: DataFrame, xx: str, xy: str, xz: str, yy: str, yz: str, zz: str) -> DataFrame:
    """Add ``l1 >= l2 >= l3`` and the unit eigenvector ``ex, ey, ez`` of ``l1``.

    Closed trigonometric form, all inside code generation. A zero matrix has NULL everywhere; a
    triple eigenvalue has NULL axis.
    """
    m = {"a": xx, "b": xy, "c": xz, "d": yy, "e": yz, "f": zz}

    def cross(u: tuple[str, ...], v: tuple[str, ...]) -> str:
        return (f"array({u[1]} * {v[2]} - {u[2]} * {v[1]}, {u[2]} * {v[0]} - {u[0]} * {v[2]}, "
                f"{u[0]} * {v[1]} - {u[1]} * {v[0]})")

    # Rows of (C - l1 I) span the plane normal to the axis: cross two of them, keep the longest product.
    rows = (("(_a - l1)", "_b", "_c"), ("_b", "(_d - l1)", "_e"), ("_c", "_e", "(_f - l1)"))
    stages = [
        {f"_{k}": v for k, v in m.items()},
        {"_q": "(_a + _d + _f) / 3"},
        {"_p": "sqrt(((_a - _q) * (_a - _q) + (_d - _q) * (_d - _q) + (_f - _q) * (_f - _q)"
               " + 2 * (_b * _b + _c * _c + _e * _e)) / 6)"},
        {"_r": "if(_p > 0, ((_a - _q) * ((_d - _q) * (_f - _q) - _e * _e) - _b * (_b * (_f - _q) - _e * _c)"
               " + _c * (_b * _e - (_d - _q) * _c)) / (2 * _p * _p * _p), null)"},
        {"_phi": "acos(if(_r < -1, -1D, if(_r > 1, 1D, _r))) / 3"},
        {"l1": "if(_p > 0, _q + 2 * _p * cos(_phi), if(_q > 0, _q, null))",
         "l3": "if(_p > 0, _q + 2 * _p * cos(_phi + 2 * pi() / 3), if(_q > 0, _q, null))"},
        {"l2": "3 * _q - l1 - l3", **{f"_c{i}": cross(rows[u], rows[v]) for i, (u, v) in enumerate(((0, 1), (0, 2), (1, 2)))}},
        {f"_n{i}": f"_c{i}[0] * _c{i}[0] + _c{i}[1] * _c{i}[1] + _c{i}[2] * _c{i}[2]" for i in range(3)},
        {"_v": "if(_n0 >= _n1 and _n0 >= _n2, _c0, if(_n1 >= _n2, _c1, _c2))", "_n": "sqrt(greatest(_n0, _n1, _n2))"},
        {k: f"if(_p > 0 and _n > 0, _v[{i}] / _n, null)" for i, k in enumerate(("ex", "ey", "ez"))},
    ]
    for stage in stages:
        df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    df = df.drop(*[f"_{k}" for k in m])
    df = df.drop("_q", "_p", "_r", "_phi", "_c0", "_c1", "_c2", "_n0", "_n1", "_n2", "_v", "_n")
    return fence(df, "l1", "l2", "l3", "ex", "ey", "ez")
