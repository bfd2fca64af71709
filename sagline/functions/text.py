"""Numbers as text, as C formats them. Formulas are SQL text, which the JVM parses in one call."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplying by this and subtracting keeps the upper half of a double's bits.
HALVES = 134217729.0


def _let(value: str, name: str, then: str) -> str:
    """``then`` of a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def fixed(value: str, digits: int) -> str:
    """``%.<digits>f`` of a double, at most nine digits: the exact binary value, rounded half to even.

    The JVM's formatter rounds the shortest decimal form instead, half up. The fraction times the power of ten is taken as a
    product and its exact error, so that every tie is seen. NULL stays NULL; from 2^63 on the JVM's digits are given.
    """
    ten = 10.0 ** digits
    upper = HALVES * ten - (HALVES * ten - ten)
    lower = ten - upper
    # The parts: whole part w and fraction f; product p and the upper half u of f; its floor n, error e and distance d from a half.
    error = f"((t.u * {upper!r}D - t.p) + t.u * {lower!r}D + (h.f - t.u) * {upper!r}D) + (h.f - t.u) * {lower!r}D"
    even = "r.n" if digits else "(r.n + h.w)"
    places = _let(f"struct(h.f * {ten!r}D AS p, h.f * {HALVES!r}D - (h.f * {HALVES!r}D - h.f) AS u)", "t", _let(
        f"struct(floor(t.p) AS n, {error} AS e, t.p - floor(t.p) - 0.5D AS d)", "r",
        f"if(r.d > -r.e OR (r.d = -r.e AND {even} % 2 = 1), r.n + 1, r.n)"))
    shown = f", '.', lpad(cast(n % {10 ** digits} AS string), {digits}, '0')" if digits else ""
    parts = _let("struct(floor(abs(v)) AS w, abs(v) - floor(abs(v)) AS f)", "h", _let(
        places, "n", f"concat(cast(if(n = {10 ** digits}, h.w + 1, h.w) AS string){shown})" if digits
        else "cast(h.w + n AS string)"))
    sign = "if(startswith(cast(v AS string), '-'), '-', '')"
    return _let(f"cast({value} AS double)", "v", f"""CASE WHEN isnan(v) THEN 'nan' WHEN abs(v) = double('Infinity') THEN concat({sign}, 'inf')
        WHEN abs(v) < {2.0 ** 63!r}D THEN concat({sign}, {parts}) WHEN v IS NOT NULL THEN format_string('%.{digits}f', v) END""")


def filled(template: str, *values: str) -> Column:
    """``template`` with its ``%d`` and ``%.<digits>f`` places filled from SQL texts."""
    kinds = re.findall(r"%(d|\.\d+f)", template)
    shown = [v if kind == "d" else fixed(v, int(kind[1:-1])) for kind, v in zip(kinds, values, strict=True)]
    return F.format_string(re.sub(r"%\.\d+f", "%s", template), *[F.expr(t) for t in shown])
