"""Mixed power sums per group in one pass over the points.

Projected coordinates sit hundreds of kilometres from the origin, so powers are summed about the
centre of the tile a point lies in, and tile sums are then moved to the group mean by the binomial
theorem. Points are read once and combined before the shuffle; everything after it has one row per
(group, tile).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.functions.geometry import fence, real_points

Exponent = tuple[int, int, int]

# What a degree-2 fit of z on x needs.
PROFILE: tuple[Exponent, ...] = ((1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (0, 0, 1), (1, 0, 1), (2, 0, 1), (0, 0, 2))
# What a degree-2 fit of z on any horizontal direction needs; holds the covariance matrix too.
SPATIAL: tuple[Exponent, ...] = tuple(
    [(i, j, 0) for i in range(5) for j in range(5) if 0 < i + j <= 4]
    + [(i, j, 1) for i in range(3) for j in range(3) if i + j <= 2]
    + [(0, 0, 2)])


# Below this share of the fourth power sum, abscissae count as fewer than three distinct ones.
DISTINCT = 1e-9


def name(e: Exponent) -> str:
    return "m%d%d%d" % e


# Formulas are composed as SQL text: a fourth-order translation has some hundred terms, and text is
# parsed by the JVM in one call where columns would take one call per term.

def product(base: Sequence[str], e: Sequence[int]) -> str:
    return " * ".join(b for b, k in zip(base, e) for _ in range(k)) or "1D"


def moved(m: Mapping[Exponent, str], n: str, d: Sequence[str], e: Exponent) -> str:
    """The sum of powers ``e`` about a point ``d`` behind the present pivot."""
    terms = []
    for i in range(e[0] + 1):
        for j in range(e[1] + 1):
            for k in range(e[2] + 1):
                low, rest = (i, j, k), (e[0] - i, e[1] - j, e[2] - k)
                c = math.comb(e[0], i) * math.comb(e[1], j) * math.comb(e[2], k)
                terms.append(f"{float(c)}D * {n if low == (0, 0, 0) else m[low]} * {product(d, rest)}")
    return " + ".join(terms)


def group_moments(df: DataFrame, by: Sequence[str], exponents: Sequence[Exponent] = PROFILE,
                  x: str = "x", y: str = "y", z: str = "z", tile: float = 8.0) -> DataFrame:
    """``by..., n, mx, my, mz`` and the central sums ``m<i><j><k>``."""
    by = list(by)
    axes = [x, y, z]
    used = [any(e[i] for e in exponents) for i in range(3)]
    df = real_points(df, *[a for a, u in zip(axes, used) if u])
    cells = [F.floor(F.col(a) / tile).alias(f"_t{i}") if u else F.lit(0).cast("long").alias(f"_t{i}")
             for i, (a, u) in enumerate(zip(axes, used))]
    base = df.select(*by, *cells, *[(F.col(a).cast("double") if u else F.lit(0.0)).alias(f"_p{i}")
                                    for i, (a, u) in enumerate(zip(axes, used))])
    off = [F.col(f"_p{i}") - (F.col(f"_t{i}") + 0.5) * tile for i in range(3)]
    base = base.select(*by, "_t0", "_t1", "_t2", *[o.alias(f"_d{i}") for i, o in enumerate(off)])
    d = ["_d0", "_d1", "_d2"]
    tiles = base.groupBy(*by, "_t0", "_t1", "_t2").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), *[F.expr(f"sum({product(d, e)})").alias(name(e)) for e in exponents])
    first = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    pivot = [(F.col(f"_t{i}") + 0.5) * tile for i in range(3)]
    means = {}
    for i, label in enumerate(("mx", "my", "mz")):
        if first[i] in exponents:
            means[label] = F.sum(F.col(name(first[i])) + F.col("_n") * pivot[i]) / F.sum("_n")
        else:
            means[label] = F.lit(None).cast("double")
    # The tile rows are kept, so that the points are not read again for the second use.
    tiles = session.cut_lineage(tiles)
    tiles = session.attach(tiles, tiles.groupBy(*by).agg(*[c.alias(n) for n, c in means.items()]), by)
    tiles = tiles.withColumns({f"_d{i}": (pivot[i] - F.col(label)) if used[i] and first[i] in exponents else F.lit(0.0)
                               for i, label in enumerate(("mx", "my", "mz"))})
    m = {e: name(e) for e in exponents}
    return tiles.groupBy(*by).agg(
        F.sum("_n").alias("n"), *[F.first(c).alias(c) for c in ("mx", "my", "mz")],
        *[F.expr(f"sum({moved(m, '_n', d, e)})").alias(name(e)) for e in exponents])


def directed(k: int, zpow: int, c: str = "c", s: str = "s") -> str:
    """Sum of ``(x c + y s)^k z^zpow`` from mixed sums, as SQL text."""
    return " + ".join(f"{float(math.comb(k, i))}D * {name((i, k - i, zpow))} * {product([c, s], (i, k - i))}"
                      for i in range(k + 1))


def parabola(df: DataFrame, n: str, u2: str, u3: str, u4: str, u1v: str, u2v: str, v2: str,
             scaled: bool = True) -> DataFrame:
    """Add ``q2, q1, q0`` (fit of v on u, both centred), ``sd`` and ``sse``; sums are given as SQL text.

    With centred sums the normal equations reduce to one division each. Fewer than three distinct
    abscissae give NULL. ``scaled`` coefficients refer to u / sd.
    """
    stages = [
        {"_u2": u2, "_u3": u3, "_u4": u4, "_a1": u1v, "_a2": u2v, "_v2": v2},
        {"sd": f"if({n} > 1 and _u2 > 0, sqrt(_u2 / ({n} - 1)), null)"},
        {"_k2": "_u2 / (sd * sd)", "_k3": "_u3 / (sd * sd * sd)", "_k4": "_u4 / (sd * sd * sd * sd)",
         "_b1": "_a1 / sd", "_b2": "_a2 / (sd * sd)"},
        {"_den": f"_k4 - _k3 * _k3 / _k2 - _k2 * _k2 / {n}"},
        {"q2": f"if(_den > {DISTINCT!r}D * _k4, (_b2 - _k3 * _b1 / _k2) / _den, null)"},
        {"q1": "(_b1 - _k3 * q2) / _k2", "q0": f"-_k2 * q2 / {n}"},
        {"sse": "greatest(0D, _v2 - q2 * _b2 - q1 * _b1) + 0 * q2"},
    ]
    if not scaled:
        stages.append({"q2": "q2 / (sd * sd)", "q1": "q1 / sd"})
    for stage in stages:
        df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    df = df.drop("_u2", "_u3", "_u4", "_a1", "_a2", "_v2", "_k2", "_k3", "_k4", "_b1", "_b2", "_den")
    return fence(df, "q2", "q1", "q0", "sse")
