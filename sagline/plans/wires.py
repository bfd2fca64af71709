"""Review of modelled wires: curve, clearance and report per wire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.operators.catenary import fit_catenary
from sagline.operators.generate import wire_curves
from sagline.operators.report import attach_fit, ground_clearance, wire_report


def wire_summary(points: DataFrame, fits: DataFrame, ground: DataFrame | None, samples: int = 300,
                 by: Sequence[str] = ("cloud_id", "wire_id"), metric: str = "3d", side: float = 1.0) -> DataFrame:
    """One row per wire: ``count``, the saved fit, the catenary, ``distance`` to ground and ``report``.

    ``fits`` may hold fewer wires than ``points``; ``ground=None`` leaves the clearance NULL.
    """
    by = list(by)
    keys = [b for b in by if b in fits.columns]
    clouds = [b for b in by[:-1] if b not in keys]
    if clouds and len(points.select(*clouds).distinct().take(2)) > 1:
        raise ValueError(f"points differ in {clouds}, which the fits do not tell; read them with a cloud_id")
    counts = points.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    curves = session.cut_lineage(fit_catenary(points, by))
    line = wire_curves(points, curves, samples, by)
    clear = ground_clearance(line, ground, by, metric, side)
    own = [c for c in ("p", "normr", "df", "rsq", "mu_mean", "mu_std")]
    out = attach_fit(counts, fits.select(*keys, *own), keys)
    out = out.join(curves.select(*by, "a", "b", "c", "sse", "converged", "method"), by, "left").join(clear, by, "left")
    return wire_report(out, by[-1], "distance")
