"""Catenary fits, one per group, with the points distributed over the cluster.

A damped Gauss-Newton search needs only ten sums per group and trial. Each round is one aggregate
over the points, which tries a ladder of damping values for every group at once and takes the best; the table of
parameters has one row per group. The curve is written in its value,
slope and curvature at the mean abscissa, which stays well conditioned for nearly straight wires:

    f(t) = h + [cosh(k u + asinh s) - cosh(asinh s)] / k,   u = t - mean t
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.functions.geometry import real_points
from sagline.operators.fit import polyfit2
from sagline.operators.shape import xy_axis

BY = ("cloud_id", "wire_id")
# Bounds of a and c, the start of the offset form (a, c, b).
A_RANGE = (1e-6, 1e6)
C_RANGE = (-1e6, 1e6)
OFFSET_START = (-780.6, 780.4, -1.184)
SUMS = ("ahh", "ahs", "ahk", "ass", "ask", "akk", "gh", "gs", "gk", "err")

# The rounds below run the same expressions many times, so they are parsed from text, once.
# Value and derivatives by h, s, k at offset u. Near k u = 0 the derivative by k is taken from its
# series, where the closed form cancels.
CURVE = (
    {"u": "t - tm", "arc": "asinh(ts)"},
    {"half": "tk * u / 2"},
    {"ratio": "if(abs(half) < 1e-8, 1.0, sinh(half) / half)"},
    {"rise": "u * ratio * sinh(arc + half)"},
    {"js": "u * ratio * cosh(arc + half) / sqrt(1 + ts * ts)",
     "jk": "if(abs(tk * u) < 1e-3, "
           "u * u / 2 * cosh(arc) + tk * u * u * u / 3 * sinh(arc) + tk * tk * u * u * u * u / 8 * cosh(arc), "
           "(u * sinh(tk * u + arc) - rise) / tk)",
     "res": "z - th - rise"},
)
TERMS = ("1D", "js", "jk", "js * js", "js * jk", "jk * jk", "res", "js * res", "jk * res", "res * res")

# A round tries these multiples of a group's damping; when none is better, the next ladder begins above them.
LADDER = (1e-3, 1e-1, 1.0, 1e1, 1e3)

# Accept or reject the best trial; ``tlam`` is the damping it was made with.
JUDGE = (
    {"usable": "new_err is not null and not isnan(new_err) and new_err < double('infinity')"},
    {"better": "not done and usable and (err is null or new_err <= err)"},
    {"done": "done or (better and (new_err = 0 or coalesce(err - new_err <= 1e-14 * err, false)"
             " or (tlam < 1e-2 and coalesce(err - new_err <= 1e-11 * err, false))))"
             " or (not better and (err is null or lam > 1e6))",
     "lam": "if(better, greatest(tlam / 10, 1e-8), lam * 1e5)",
     **{c: f"if(better, t{c}, {c})" for c in "hsk"}, **{c: f"if(better, new_{c}, {c})" for c in SUMS}},
)
# Next trial: k from the damped normal equations, then s and h for that k.
STEP = (
    {"d0": "ahh * (1 + lam)", "d1": "ass * (1 + lam)", "d2": "akk * (1 + lam)"},
    {"det": "d0 * (d1 * d2 - ask * ask) - ahs * (ahs * d2 - ask * ahk) + ahk * (ahs * ask - d1 * ahk)"},
    {"tk": "k + (d0 * (d1 * gk - gs * ask) - ahs * (ahs * gk - gs * ahk) + gh * (ahs * ask - d1 * ahk)) / nullif(det, 0)"},
)
SOLVE = (
    {"ts": "s + (d0 * (gs - ask * (tk - k)) - ahs * (gh - ahk * (tk - k))) / nullif(d0 * d1 - ahs * ahs, 0)"},
    {"th": "h + (gh - ahk * (tk - k) - ahs * (ts - s)) / d0"},
)
CLAMP = ({"tk": f"case when tk < {1 / A_RANGE[1]!r} then {1 / A_RANGE[1]!r} when tk > {1 / A_RANGE[0]!r} then {1 / A_RANGE[0]!r} else tk end"},)
# Bounds of b. A trial that leaves them is moved back; when the present curve is already on the
# bound, the step is taken along it.
EDGE = (
    {"b1": "tm - asinh(ts) / tk", "b0": "tm - asinh(s) / k"},
    {"bb": "case when b1 < blo then blo when b1 > bhi then bhi end"},
    {"on": "coalesce(abs(b0 - bb) <= 1e-9 * (1 + abs(bb)), false)", "w": "(tm - bb) * sqrt(1 + s * s)"},
    {"tk": "if(on, k + (d0 * (gk + w * gs) - (ahk + w * ahs) * gh)"
           " / nullif(d0 * (akk + 2 * w * ask + w * w * ass) * (1 + lam) - (ahk + w * ahs) * (ahk + w * ahs), 0), tk)"},
)
EDGE_BACK = (
    {"th": "if(on, h + (gh - (ahk + w * ahs) * (tk - k)) / d0, th)", "ts": "if(bb is null, ts, sinh(tk * (tm - bb)))"},
    {"arm": "sqrt(1 + ts * ts) / tk"},
    {"th": f"case when th - arm < {C_RANGE[0]!r} then {C_RANGE[0]!r} + arm when th - arm > {C_RANGE[1]!r} then {C_RANGE[1]!r} + arm else th end"},
)
# A trial that moves nothing is not made; a group without trials is done.
STOP = ({"still": "coalesce(abs(th - h) <= 1e-13 * (1 + abs(h)) and abs(ts - s) <= 1e-13 * (1 + abs(s))"
                  " and abs(tk - k) <= 1e-12 * abs(k), true)"},)
BOUNDED = (*STEP, *CLAMP, *SOLVE, *EDGE, *CLAMP, *EDGE_BACK, *STOP)
FREE = (*STEP, *SOLVE, *STOP)


def _parsed(*stages: dict[str, str]) -> list[dict[str, Column]]:
    return [{k: F.expr(v) for k, v in stage.items()} for stage in stages]


def _apply(df: DataFrame, stages: list[dict[str, Column]]) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df


def _tried(data: DataFrame, trials: DataFrame, by: list[str], curve: list[dict[str, Column]], sums: list[Column]) -> DataFrame:
    """One read of the points: the best trial of each group, ``by..., th, ts, tk, tlam, new_*``."""
    made = [*by, "rung", "tm", "th", "ts", "tk"]
    found = _apply(data.join(trials.select(made), by), curve).groupBy(*by, "rung").agg(*sums)
    found = found.join(trials.select(*by, "rung", "th", "ts", "tk", F.col("lam").alias("tlam")), [*by, "rung"])
    # NaN and infinity stand after every number.
    order = F.struct(F.coalesce("new_err", F.lit(float("nan"))), "rung")
    kept = [c for c in found.columns if c not in (*by, "rung")]
    return found.groupBy(*by).agg(F.min_by(F.struct(*kept), order).alias("_t")).select(*by, "_t.*")


def _search(data: DataFrame, start: DataFrame, by: list[str], bounded: bool, max_rounds: int | None) -> DataFrame:
    """Minimise each group's squared error from ``by..., tm, th, ts, tk`` (and ``blo, bhi``).

    ``data`` (``by..., t, z``) has been materialised by the caller. The search goes on until every group is done:
    an accepted step lowers the error by a least share, and a ladder without one raises the damping up to a limit. With
    ``max_rounds`` it may end before; ``done`` tells which groups had ended. Whenever half of the groups have
    ended since, the points of the others are written anew, so that later rounds read only those.
    """
    state = start.withColumns({
        **{c: F.lit(None).cast("double") for c in ("h", "s", "k", *SUMS)}, "lam": F.lit(1e-3), "done": F.lit(False)})
    if bounded:
        state = _apply(state, _parsed(*CLAMP, {"b1": "tm - asinh(ts) / tk"},
                                      {"ts": "if(b1 < blo, sinh(tk * (tm - blo)), if(b1 > bhi, sinh(tk * (tm - bhi)), ts))"}))
    keep = [c for c in state.columns if c not in ("b1", "th", "ts", "tk")]
    trials = session.cut_lineage(state.withColumn("rung", F.lit(0)).select(*keep, "rung", "th", "ts", "tk"))
    state = trials.select(keep)
    held = state.count()
    curve, judge, step = _parsed(*CURVE), _parsed(*JUDGE), _parsed(*(BOUNDED if bounded else FREE))
    sums = [F.sum(F.expr(e)).alias(f"new_{n}") for n, e in zip(SUMS, TERMS)]
    rungs = F.posexplode(F.array(*[F.lit(m) for m in LADDER]))
    rounds = 0
    while held and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        # A group has a row for each rung.
        small = held * len(LADDER) <= session.BROADCAST_ROWS
        best = _tried(data, F.broadcast(trials) if small else trials, by, curve, sums)
        judged = _apply(state.join(best, by, "left"), judge).select(*keep, rungs.alias("rung", "_m"))
        judged = judged.withColumns({"base": F.col("lam"), "lam": F.col("lam") * F.col("_m")})
        # Filtered behind the cut: pushed below the steps, a condition would repeat their formulas many times over.
        made = session.cut_lineage(_apply(judged, step).select(*keep, "base", "rung", "th", "ts", "tk", "still"))
        state = made.where("rung = 0").withColumn("lam", F.col("base")).select(keep)
        trials = made.where("not done and not still").select(*keep, "rung", "th", "ts", "tk")
        open_ = trials.select(*by).distinct()
        left = open_.count()
        if not left:
            # What still stands open has no trial that moves it.
            state = state.withColumn("done", F.lit(True))
            break
        if 2 * left <= held:
            data, held = session.cut_lineage(data.join(F.broadcast(open_) if small else open_, by, "left_semi")), left
    return state


def fit_catenary(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
                 accept: float | None = None, max_rounds: int | None = None) -> DataFrame:
    """One row per group of at least four points: ``a, b, c`` of z = a cosh((t - b) / a) + c.

    t runs along the group's horizontal axis from 0 to ``span``. Also returned are the axis
    (``mean_x, mean_y, ux, uy, t0``), ``sse``, ``converged`` and ``method``: ``catenary``, or ``interpolated``
    where no curve was found. ``accept`` also gives up a curve whose squared error exceeds that many times the
    parabola's. ``converged`` is false only for groups that ``max_rounds`` has cut short.
    """
    by = list(by)
    axis = session.sized(xy_axis(points, by, x, y).where(F.col("n") >= 4))
    along = (F.col(x) - F.col("mean_x")) * F.col("ux") + (F.col(y) - F.col("mean_y")) * F.col("uy")
    data = real_points(points, x, y, z).join(axis, by).select(*by, along.alias("t"), F.col(z).cast("double").alias("z"))
    data = session.cut_lineage(data)
    para = polyfit2(data, by, "t", "z")
    ends = data.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    start = para.join(ends, by).select(*by, "t0", (F.col("t1") - F.col("t0")).alias("span"), F.col("mu_mean").alias("tm"),
                                       (F.col("normr") * F.col("normr")).alias("sse2"), "p", "mu_std")
    start = start.where(F.col("p").isNotNull() & (F.col("mu_std") > 0)).select(
        *by, "t0", "span", "tm", "sse2", F.col("p")[2].alias("th"), (F.col("p")[1] / F.col("mu_std")).alias("ts"),
        (2.0 * F.col("p")[0] / (F.col("mu_std") * F.col("mu_std"))).alias("tk"),
        (F.col("t0") - F.col("span") - 1.0).alias("blo"), (F.col("t0") + 2.0 * F.col("span") + 1.0).alias("bhi"))
    out = _search(data, start, by, True, max_rounds)
    k, arc = F.col("k"), F.asinh("s")
    ok = F.col("err").isNotNull() & (F.lit(True) if accept is None else F.col("err") <= F.col("sse2") * accept + 1e-18)
    fits = out.select(*by, F.when(ok, 1.0 / k).alias("a"), F.when(ok, F.col("tm") - arc / k - F.col("t0")).alias("b"),
                      F.when(ok, F.col("h") - F.cosh(arc) / k).alias("c"), F.when(ok, F.col("err")).alias("sse"), F.col("done").alias("converged"))
    return axis.join(ends, by).join(fits, by, "left").select(
        *by, "n", "mean_x", "mean_y", "ux", "uy", "t0", (F.col("t1") - F.col("t0")).alias("span"), "a", "b", "c", "sse",
        F.coalesce("converged", F.lit(True)).alias("converged"), F.when(F.col("a").isNotNull(), "catenary").otherwise("interpolated").alias("method"))


def fit_catenary_offset(points: DataFrame, by: Sequence[str] = BY, x: str = "x", z: str = "z",
                        start: Sequence[float] | None = OFFSET_START, max_rounds: int | None = None) -> DataFrame:
    """``by..., n, a, c, b, sse, converged`` of z = a + c cosh((x - b) / c), unbounded, from the given start.

    ``start=None`` starts from the parabola, as do groups where the given start overflows.
    """
    by = list(by)
    data = real_points(points, x, z).select(*by, F.col(x).cast("double").alias("t"), F.col(z).cast("double").alias("z"))
    data = session.cut_lineage(data)
    para = polyfit2(data, by, "t", "z")
    ends = data.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    para = para.join(ends, by).where(F.col("p").isNotNull() & (F.col("mu_std") > 0))
    bent = 2.0 * F.col("p")[0] / (F.col("mu_std") * F.col("mu_std"))
    own = {"th": F.col("p")[2], "ts": F.col("p")[1] / F.col("mu_std"),
           "tk": F.when(F.abs(bent) > 1e-9, bent).otherwise(1e-9)}
    if start is not None:
        a, c, b = (float(v) for v in start)
        fits_in = F.greatest(F.abs(F.col("t0") - b), F.abs(F.col("t1") - b)) / abs(c) < 300.0
        lever = (F.col("mu_mean") - b) / c
        given = {"th": a + c * F.cosh(lever), "ts": F.sinh(lever), "tk": F.lit(1.0 / c)}
        own = {n: F.when(fits_in, given[n]).otherwise(own[n]) for n in own}
    state = para.select(*by, "n", F.col("mu_mean").alias("tm"), *[v.alias(n) for n, v in own.items()])
    out = _search(data, state, by, False, max_rounds)
    k, arc = F.col("k"), F.asinh("s")
    return out.where(F.col("err").isNotNull() & (k != 0)).select(
        *by, "n", (F.col("h") - F.cosh(arc) / k).alias("a"), (1.0 / k).alias("c"), (F.col("tm") - arc / k).alias("b"),
        F.col("err").alias("sse"), F.col("done").alias("converged"))
