"""Evaluation of fitted curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def horner(coef: Column, t: Column) -> Column:
    """Polynomial of any degree, highest power first."""
    return F.aggregate(coef, F.lit(0.0), lambda acc, c: acc * t + c)


def catenary(coef: Column, t: Column) -> Column:
    """``[a, b, c]`` -> a cosh((t - b) / (a + 1e-12)) + c."""
    return coef[0] * F.cosh((t - coef[1]) / (coef[0] + 1e-12)) + coef[2]


def catenary_offset(coef: Column, t: Column) -> Column:
    """``[a, c, b]`` -> a + c cosh((t - b) / c)."""
    return coef[0] + coef[1] * F.cosh((t - coef[2]) / coef[1])


def polyval(model: Column, coef: Column, t: Column) -> Column:
    """Value of the model named in ``model``: polynomial, catenary or catenary_offset."""
    return (F.when(model == "polynomial", horner(coef, t))
            .when(model == "catenary", catenary(coef, t))
            .when(model == "catenary_offset", catenary_offset(coef, t)))
