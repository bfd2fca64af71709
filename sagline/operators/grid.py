"""Distance joins on grid keys: all pairs within a radius, links between cells, nearest point.

Every join here is an equi-join on integer cells. Where one cell holds many points, cells are
halved level by level: a pair of cells that lies wholly within the radius is settled from the
cells' sums, a pair wholly outside is dropped, and only pairs small enough reach single points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagline import session
from sagline.functions.geometry import real_points

BY = ("cloud_id",)
# Above this many points in one cell the radius operators change to cell halving.
CELL_ROWS = 2_000
# Above this many points in one cell a radius join's cells are half as wide, so that fewer pairs beyond the radius are compared.
FINE_ROWS = 200
# A pair of cells with at most this many point pairs is compared point by point.
LEAF_PAIRS = 4_096
# Cells are halved at most this many times.
MAX_LEVEL = 12

# Neighbourhood sums of clouds with cells up to so many times fuller come from matrix products per cell, without halving.
MATRIX_CELLS = 20
# Such a cell is cut into this many parts along each axis, and so many pairs of points are compared at once.
PARTS = 4
MATRIX_PAIRS = 131_072

# A block is so many cells wide; a point is sent to its own block and to those whose rim of one cell holds it.
BLOCK_CELLS = 8
# Point pairs of a block that are compared at once.
BLOCK_PAIRS = 1_000_000

# The nearest point's cells are cut until none holds more points than this, at most so many times.
LEAF_ROWS = 64
MAX_CUTS = 12

AXES = ("x", "y", "z")
SUMS = ("n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


def cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def _offsets(reach: int, half: bool = False) -> list[tuple[int, ...]]:
    span = range(-reach, reach + 1)
    every = list(itertools.product(span, span, span))
    return [o for o in every if o > (0, 0, 0)] if half else every


def _offset_array(offsets: list[tuple[int, ...]]) -> Column:
    return F.expr("array(" + ", ".join("named_struct('i', %dL, 'j', %dL, 'k', %dL)" % o for o in offsets) + ")")


def _xyz(points: DataFrame, by: Sequence[str], x: str, y: str, z: str, *extra: str) -> DataFrame:
    return real_points(points, x, y, z).select(
        *by, *extra, *[F.col(c).cast("double").alias(a) for a, c in zip(AXES, (x, y, z))])


def _dist2(a: str, b: str) -> Column:
    dx, dy, dz = (F.col(f"{b}{c}") - F.col(f"{a}{c}") for c in AXES)
    return dx * dx + dy * dy + dz * dz


def fullest_cell(points: DataFrame, by: Sequence[str], side: float) -> int:
    """Number of points in the fullest cell of a cloud given as ``by..., x, y, z``."""
    counts = points.groupBy(*by, *[cell(a, side).alias(f"k{a}") for a in AXES]).count()
    return counts.agg(F.max("count")).first()[0] or 0


def _adjacent(queries: DataFrame, by: Sequence[str], radius: float, side: float, reach: int) -> DataFrame:
    """Query rows ``by..., q_id, qx, qy, qz`` repeated for the cells around them that come within ``radius``."""
    q = queries.withColumn("_o", F.explode(_offset_array(_offsets(reach))))
    gaps = F.lit(0.0)
    for a, o in zip(AXES, "ijk"):
        at, low = F.col(f"q{a}"), (cell(f"q{a}", side) + F.col(f"_o.{o}")) * side
        # Less what rounding can move a cell's border by.
        gap = F.greatest(F.greatest(low - at, at - low - side) - F.abs(at) * 1e-15, F.lit(0.0))
        gaps = gaps + gap * gap
    return q.where(gaps <= radius * radius * (1.0 + 1e-9)).select(*by, "q_id", "qx", "qy", "qz", *[
        (cell(f"q{a}", side) + F.col(f"_o.{o}")).alias(f"k{a}") for a, o in zip(AXES, "ijk")])


def radius_pairs(queries: DataFrame, targets: DataFrame, radius: float, by: Sequence[str],
                 bucket_rows: int | None = None, parts: int = 1) -> DataFrame:
    """``by..., q_id, n_id`` and both positions for all pairs within ``radius``.

    ``queries`` has ``q_id, qx, qy, qz`` and ``targets`` ``n_id, nx, ny, nz``. A cell is the radius over ``parts`` wide.
    With ``bucket_rows`` the targets of a full cell are dealt to several buckets, so that no task meets the whole cell.
    """
    keys = [*by, "kx", "ky", "kz"]
    # Wider by a hair, so that rounding cannot put two neighbours too many cells apart.
    side = radius / parts * (1.0 + 1e-9)
    q = _adjacent(queries, by, radius, side, parts)
    t = targets.withColumns({f"k{a}": cell(f"n{a}", side) for a in AXES})
    if bucket_rows:
        full = t.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("_buckets"))
        full = session.sized(full)
        q = q.join(full, keys).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))).drop("_buckets")
        t = t.join(full, keys).withColumn("_b", F.pmod(F.xxhash64("n_id"), F.col("_buckets")).cast("int")).drop("_buckets")
        keys.append("_b")
    # The work is in the pairs, so few rows are spread over all partitions as well.
    spread = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, t = q.repartition(spread, *keys).alias("q"), t.repartition(spread, *keys).alias("t")
    near = _dist2("q", "n") <= radius * radius
    for k in keys:
        near = near & (F.col(f"q.{k}") == F.col(f"t.{k}"))
    return q.join(t, near).select(*[F.col(f"q.{b}").alias(b) for b in by], "q_id", "n_id",
                                  *[f"q{a}" for a in AXES], *[f"n{a}" for a in AXES])


def radius_join(points: DataFrame, radius: float, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """``by..., q_id, n_id, dist2``: all ordered pairs within ``radius``, boundary and self included."""
    p = _xyz(points, by, x, y, z, "point_id")
    fullest = fullest_cell(p, by, radius)
    q = p.select(*by, F.col("point_id").alias("q_id"), *[F.col(a).alias(f"q{a}") for a in AXES])
    t = p.select(*by, F.col("point_id").alias("n_id"), *[F.col(a).alias(f"n{a}") for a in AXES])
    pairs = radius_pairs(q, t, radius, by, cell_rows if fullest > cell_rows else None, 2 if fullest > FINE_ROWS else 1)
    return pairs.select(*by, "q_id", "n_id", _dist2("q", "n").alias("dist2"))


def neighbour_sums(points: DataFrame, radius: float, by: Sequence[str] = BY, x: str = "x", y: str = "y",
                   z: str = "z", cell_rows: int = CELL_ROWS, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """``by..., point_id, n, sx..szz``: sums of offsets from each point to its neighbours within ``radius``.

    Points meet in blocks, which give whole sums; when a cell is fuller than ``cell_rows``, blocks are single cells and
    the sums are matrix products. Where a cell is fuller than ``MATRIX_CELLS`` times that, copies of a position are
    merged first and full cells enter as sums (see :func:`_dense_sums`).
    """
    p = _xyz(points, by, x, y, z, "point_id")
    fullest = fullest_cell(p, by, radius)
    if fullest > cell_rows * MATRIX_CELLS:
        return _dense_sums(p, radius, list(by), leaf_pairs)
    if fullest > cell_rows:
        return _block_sums(p, radius, list(by), _sums_in_cell, 1)
    return _block_sums(p, radius, list(by), _sums_in_block, BLOCK_CELLS)


# --- blocks with a halo --------------------------------------------------------------------------

def in_blocks(points: DataFrame, by: Sequence[str], radius: float, cells: int = BLOCK_CELLS) -> DataFrame:
    """Each point with a block ``_bx, _by, _bz``: once for its own (``_own``), and for every block whose halo holds it.

    Blocks are ``cells`` cells wide and the halo is one cell, so with eight cells a point is sent about twice, with one 27
    times. Cells are wider than the radius by a hair, so that rounding cannot put two neighbours two cells apart.
    """
    side = radius * (1.0 + 1e-9)
    last = cells - 1
    out = points
    for a in AXES:
        inner = F.pmod(cell(a, side), F.lit(cells))
        shift = F.when(inner == 0, F.array(F.lit(-1), F.lit(0))).when(inner == last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        out = out.withColumn(f"_s{a}", F.explode(shift if last else F.array(F.lit(-1), F.lit(0), F.lit(1))))
    block = {a: F.floor(cell(a, side) / cells).cast("long") + F.col(f"_s{a}") for a in AXES}
    own = (F.col("_sx") == 0) & (F.col("_sy") == 0) & (F.col("_sz") == 0)
    return out.select(*by, *[block[a].alias(f"_b{a}") for a in AXES], own.alias("_own"), "point_id", *AXES)


def _sums_in_block(rows: pd.DataFrame, keys: list[str], radius: float) -> pd.DataFrame:
    """:func:`neighbour_sums` of the points that own the block, among all that were sent to it."""
    xyz = rows[list(AXES)].to_numpy(np.float64)
    at = np.floor(xyz / (radius * (1.0 + 1e-9))).astype(np.int64)
    # Cells counted from one below the block's halo; three neighbours in z are one run of the order.
    at -= at.min(0) - 1
    wide = at.max(0) + 2
    number = (at[:, 0] * wide[1] + at[:, 1]) * wide[2] + at[:, 2]
    # Neighbours are added up in the order of their ids, so that every run gives the same sums.
    order = np.lexsort((rows["point_id"].to_numpy(), number))
    number, xyz = number[order], xyz[order]
    mine = np.flatnonzero(rows["_own"].to_numpy()[order])
    runs = np.array([(i * wide[1] + j) * wide[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    first = np.searchsorted(number, number[mine][:, None] + runs - 1, "left").ravel()
    length = np.searchsorted(number, number[mine][:, None] + runs + 1, "right").ravel() - first
    sums = np.zeros((len(mine), len(SUMS)))
    pairs = np.append(0, np.cumsum(length.reshape(-1, len(runs)).sum(1)))
    start = 0
    while start < len(mine):
        end = max(int(np.searchsorted(pairs, pairs[start] + BLOCK_PAIRS, "right")) - 1, start + 1)
        part = slice(start * len(runs), end * len(runs))
        size, begin = length[part], first[part]
        query = np.repeat(np.arange(end - start), size.reshape(-1, len(runs)).sum(1))
        near = np.arange(len(query)) + np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size)
        d = xyz[near] - xyz[mine[start + query]]
        within = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2] <= radius * radius
        query, d = query[within], d[within]
        terms = [None, *d.T, *(d[:, i] * d[:, j] for i, j in itertools.combinations_with_replacement(range(3), 2))]
        for i, t in enumerate(terms):
            sums[start:end, i] = np.bincount(query, t, end - start)
        start = end
    return _with_ids(sums, rows["point_id"].to_numpy()[order][mine], rows, keys)


def _with_ids(sums: np.ndarray, ids: np.ndarray, rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(sums, columns=list(SUMS))
    out.insert(0, "point_id", ids)
    for k in reversed(keys):
        out.insert(0, k, rows[k].iloc[0])
    return out


def _terms(d: np.ndarray) -> np.ndarray:
    """What :data:`SUMS` adds up, a column each, of offsets ``d``."""
    squares = [d[:, i] * d[:, j] for i, j in itertools.combinations_with_replacement(range(3), 2)]
    return np.column_stack([np.ones(len(d)), d, *squares])


def _sums_in_cell(rows: pd.DataFrame, keys: list[str], radius: float) -> pd.DataFrame:
    """:func:`_sums_in_block` for full cells. The points of a small part of the cell meet all others together.

    Points that all of them have as neighbours are added up once. The others' part is the product of the matrix that tells
    who is whose neighbour with the terms of the sums, which are about the middle of the part and then moved to each point.
    """
    own, ids = rows["_own"].to_numpy(), rows["point_id"].to_numpy()
    xyz = rows[list(AXES)].to_numpy(np.float64)
    order = np.argsort(ids, kind="stable")
    own, ids, xyz = own[order], ids[order], xyz[order]
    mine = np.flatnonzero(own)
    sums = np.zeros((len(mine), len(SUMS)))
    if len(mine):
        at = np.floor(xyz[mine] / (radius * (1.0 + 1e-9) / PARTS)).astype(np.int64)
        at -= at.min(0)
        number = (at[:, 0] * (at[:, 1].max() + 1) + at[:, 1]) * (at[:, 2].max() + 1) + at[:, 2]
        part = np.argsort(number, kind="stable")
        for group in np.split(part, np.flatnonzero(np.diff(number[part])) + 1):
            sums[group] = _sums_of_part(xyz[mine[group]], xyz, radius)
    return _with_ids(sums, ids[mine], rows, keys)


def _sums_of_part(q: np.ndarray, xyz: np.ndarray, radius: float) -> np.ndarray:
    lo, hi, r2 = q.min(0), q.max(0), radius * radius
    pivot = (lo + hi) / 2
    below, above = lo - xyz, xyz - hi
    near = np.maximum(np.maximum(below, above), 0.0)
    met = np.flatnonzero((near * near).sum(1) <= r2 * (1 + 1e-9))
    far = np.maximum(hi - xyz[met], xyz[met] - lo)
    # The margin leaves what rounding might decide to the comparison of single points.
    full = (far * far).sum(1) <= r2 * (1 - 1e-9)
    always = _terms(xyz[met[full]] - pivot).sum(0)
    other = xyz[met[~full]]
    terms = _terms(other - pivot)
    sums = np.empty((len(q), len(SUMS)))
    step = max(MATRIX_PAIRS // max(len(other), 1), 1)
    for start in range(0, len(q), step):
        some = q[start:start + step]
        d2 = np.zeros((len(some), len(other)))
        for i in range(3):
            d = other[None, :, i] - some[:, None, i]
            d *= d
            d2 += d
        sums[start:start + step] = (d2 <= r2).astype(np.float64) @ terms + always
    o, n = q - pivot, sums[:, 0]
    first = sums[:, 1:4].copy()
    sums[:, 1:4] -= n[:, None] * o
    for k, (i, j) in enumerate(itertools.combinations_with_replacement(range(3), 2)):
        sums[:, 4 + k] += n * o[:, i] * o[:, j] - o[:, i] * first[:, j] - o[:, j] * first[:, i]
    return sums


def _block_sums(points: DataFrame, radius: float, by: list[str], summed, cells: int) -> DataFrame:
    """:func:`neighbour_sums` with one exchange; a block is bounded, as no cell of these clouds is fuller than was counted.

    The work is in the pairs, so few rows are spread over all partitions as well.
    """
    fields = [f for f in points.schema if f.name in (*by, "point_id")]
    schema = T.StructType([*sorted(fields, key=lambda f: [*by, "point_id"].index(f.name)), *[T.StructField(n, T.DoubleType()) for n in SUMS]])
    keys = [*by, *[f"_b{a}" for a in AXES]]
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = in_blocks(points, by, radius, cells).repartition(spread, *keys)
    return sent.groupBy(*keys).applyInPandas(lambda rows: summed(rows, by, radius), schema)


# --- cell halving ------------------------------------------------------------------------------

def _fine(positions: DataFrame, side: float, prefix: str = "") -> DataFrame:
    """Add the cell ``f*`` on the finest level; coarser cells are right shifts of it."""
    fine = side / 2 ** MAX_LEVEL
    return positions.withColumns({f"f{a}": cell(prefix + a, fine) for a in AXES})


def _level(a: str, level: Column | int) -> Column:
    shift = F.lit(MAX_LEVEL) - level
    return F.call_function("shiftright", F.col(f"f{a}"), shift.cast("int"))


def _cells(positions: DataFrame, by: Sequence[str], side: float, level: int, sums: bool = False) -> DataFrame:
    """Occupied cells of one level: number of positions, box, parent and, on request, weighted sums.

    Sums are about the centre of the cell, which its key gives.
    """
    keyed = positions.withColumns({f"k{a}": _level(a, level) for a in AXES})
    out = [F.count(F.lit(1)).alias("m"),
           *[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES]]
    if sums:
        keyed = keyed.withColumns({f"d{a}": F.col(a) - _centre(f"k{a}", side, level) for a in AXES})
        out += _weighted_sums(F.col("w"))
    return keyed.groupBy(*by, "kx", "ky", "kz").agg(*out)


def _centre(key: str, side: float, level: Column | int) -> Column:
    half = side / F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(side / 2 ** level)
    return (F.col(key) + 0.5) * half


def _weighted_sums(w: Column) -> list[Column]:
    first = [F.sum(w * F.col(f"d{a}")).alias(f"s{a}") for a in AXES]
    second = [F.sum(w * F.col(f"d{a}") * F.col(f"d{b}")).alias(f"s{a}{b}")
              for a, b in itertools.combinations_with_replacement(AXES, 2)]
    return [F.sum(w).alias("n"), *first, *second]


def _moved_sums(d: Sequence[Column], p: str) -> dict[str, Column]:
    """The sums in columns ``p + name`` about a point ``d`` behind their pivot."""
    d, n = dict(zip(AXES, d)), F.col(f"{p}n")
    out = {"n": n, **{f"s{a}": F.col(f"{p}s{a}") + n * d[a] for a in AXES}}
    for a, b in itertools.combinations_with_replacement(AXES, 2):
        out[f"s{a}{b}"] = F.col(f"{p}s{a}{b}") + d[a] * F.col(f"{p}s{b}") + d[b] * F.col(f"{p}s{a}") + n * d[a] * d[b]
    return out


def _box_distance(near: bool) -> Column:
    """Squared least (or greatest) distance between the boxes of cells a and b."""
    total = F.lit(0.0)
    for a in AXES:
        if near:
            gap = F.greatest(F.col(f"b_lo{a}") - F.col(f"a_hi{a}"), F.col(f"a_lo{a}") - F.col(f"b_hi{a}"), F.lit(0.0))
        else:
            gap = F.greatest(F.col(f"b_hi{a}") - F.col(f"a_lo{a}"), F.col(f"a_hi{a}") - F.col(f"b_lo{a}"))
        total = total + gap * gap
    return total


def _cell_pairs(cells: DataFrame, by: Sequence[str], offsets: list[tuple[int, ...]]) -> DataFrame:
    """Keys ``a_k*, b_k*`` of each cell and the cells at the given offsets, occupied or not."""
    pairs = cells.select(*by, "kx", "ky", "kz").withColumn("_o", F.explode(_offset_array(offsets)))
    return pairs.select(*by, *[F.col(f"k{a}").alias(f"a_k{a}") for a in AXES],
                        *[(F.col(f"k{a}") + F.col(f"_o.{o}")).alias(f"b_k{a}") for a, o in zip(AXES, "ijk")])


A_KEYS, B_KEYS = [f"a_k{a}" for a in AXES], [f"b_k{a}" for a in AXES]


def _refine(positions: DataFrame, by: list[str], side: float, distance: float, offsets: list[tuple[int, ...]],
            leaf_pairs: int, sums: bool = False, root: bool = False, settle=None) -> DataFrame:
    """Halve cell pairs until each is ``full`` (wholly within the distance) or a small ``leaf``.

    ``root`` keeps the level-0 pair as ``ra*, rb*``; ``settle`` removes pairs that an earlier result
    makes needless. Returns the pairs with ``kind`` and ``level``.
    """
    cells = _cells(positions, by, side, 0, sums)
    frontier = _cell_pairs(cells, by, offsets)
    if root:
        frontier = frontier.withColumns({f"r{p}{a}": F.col(f"{p}_k{a}") for p in "ab" for a in AXES})
    carry = [c for c in frontier.columns if c not in (*by, *A_KEYS, *B_KEYS)]
    done, d2 = [], distance * distance
    for level in range(MAX_LEVEL + 1):
        pairs = frontier
        for p, keys in (("a_", A_KEYS), ("b_", B_KEYS)):
            pairs = pairs.join(cells.select(*by, *[F.col(c).alias(p + c) for c in cells.columns if c not in by]), [*by, *keys])
        pairs = pairs.withColumns({"_near": _box_distance(True), "_far": _box_distance(False)}).where(F.col("_near") <= d2)
        leaf = F.lit(True) if level == MAX_LEVEL else F.col("a_m") * F.col("b_m") <= leaf_pairs
        kind = F.when(F.col("_far") <= d2, "full").when(leaf, "leaf").otherwise("split")
        pairs = session.cut_lineage(pairs.withColumns({"kind": kind, "level": F.lit(level)}).drop("_near", "_far"))
        if settle is not None:
            pairs = settle(pairs)
        done.append(pairs.where(F.col("kind") != "split"))
        frontier = pairs.where(F.col("kind") == "split").select(*by, *carry, *A_KEYS, *B_KEYS)
        if session.is_empty(frontier):
            break
        cells = _cells(positions, by, side, level + 1, sums)
        for keys in (A_KEYS, B_KEYS):
            child = cells.select(*by, *[F.shiftright(f"k{a}", 1).alias(k) for a, k in zip(AXES, keys)],
                                 *[F.col(f"k{a}").alias(f"_n{a}") for a in AXES])
            frontier = frontier.join(child, [*by, *keys]).drop(*keys).withColumnsRenamed(
                {f"_n{a}": k for a, k in zip(AXES, keys)})
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _leaf_points(found: DataFrame, positions: DataFrame, by: list[str], distance: float, *keep: str) -> DataFrame:
    """Point pairs within the distance of all leaf cell pairs: ``q*, n*, w`` and the ``keep`` columns."""
    depth = found.agg(F.max("level")).first()[0] or 0
    leaves = found.where(F.col("kind") == "leaf").select(*by, "level", *keep, *A_KEYS, *B_KEYS)
    tagged = _tagged(positions, by, depth)
    for p, keys, weight in (("q", A_KEYS, ()), ("n", B_KEYS, ("w",))):
        side = tagged.select(*by, "level", *[F.col(f"k{a}").alias(k) for a, k in zip(AXES, keys)],
                             *[F.col(a).alias(f"{p}{a}") for a in AXES], *weight)
        leaves = leaves.join(side, [*by, "level", *keys])
    return leaves.where(_dist2("q", "n") <= distance * distance)


def _tagged(positions: DataFrame, by: list[str], depth: int) -> DataFrame:
    """Positions once per level with their cell key on it."""
    out = positions.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return out.select(*by, "level", *[_level(a, F.col("level")).alias(f"k{a}") for a in AXES], *AXES, "w")


def _dense_sums(points: DataFrame, radius: float, by: list[str], leaf_pairs: int) -> DataFrame:
    """:func:`neighbour_sums` for clouds with full cells: work grows with cells, not with point pairs."""
    positions = points.groupBy(*by, *AXES).agg(F.count(F.lit(1)).cast("double").alias("w"))
    positions = session.cut_lineage(_fine(positions, radius))
    found = _refine(positions, by, radius, radius, _offsets(1), leaf_pairs, sums=True)
    keys = [*by, "level", "kx", "ky", "kz"]

    # Sums of b about the centre of a, added up per cell a of each level.
    width = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
    shifted = _moved_sums([(F.col(f"b_k{a}") - F.col(f"a_k{a}")) * width for a in AXES], "b_")
    full = found.where(F.col("kind") == "full").select(
        *by, "level", *[F.col(k).alias(f"k{a}") for a, k in zip(AXES, A_KEYS)], *[c.alias(f"_{s}") for s, c in shifted.items()])
    full = full.groupBy(*keys).agg(*[F.sum(f"_{s}").alias(f"_{s}") for s in SUMS])

    depth = found.agg(F.max("level")).first()[0] or 0
    inside = _tagged(positions, by, depth).join(full, keys)
    moved = _moved_sums([_centre(f"k{a}", radius, F.col("level")) - F.col(a) for a in AXES], "_")
    inside = inside.select(*by, *AXES, *[c.alias(s) for s, c in moved.items()])

    edge = _leaf_points(found, positions, by, radius).select(
        *by, *[F.col(f"q{a}").alias(a) for a in AXES], "w", *[(F.col(f"n{a}") - F.col(f"q{a}")).alias(f"d{a}") for a in AXES])
    edge = edge.groupBy(*by, *AXES).agg(*_weighted_sums(F.col("w")))
    total = inside.unionByName(edge).groupBy(*by, *AXES).agg(*[F.sum(s).alias(s) for s in SUMS])
    return points.join(total, [*by, *AXES]).select(*by, "point_id", *SUMS)


# --- links between cells -----------------------------------------------------------------------

def link_side(distance: float) -> float:
    """Side of a cell whose diagonal is the linking distance; shaved to stay below it in floating point."""
    return distance / math.sqrt(3.0) * (1.0 - 1e-9)


def linking_cells(points: DataFrame, distance: float, prefix: str = "") -> DataFrame:
    """Add the key ``k*`` of each point's linking cell, from the columns ``prefix + x, y, z``."""
    fine = _fine(points, link_side(distance), prefix)
    return fine.withColumns({f"k{a}": _level(a, 0) for a in AXES}).drop(*[f"f{a}" for a in AXES])


def link_join(points: DataFrame, distance: float, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
              leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """``by..., node_a < node_b``: pairs of linking cells that hold two points within ``distance``.

    A cell is named by its least ``point_id``; its own points are linked by construction. Copies of
    a position count once, and cell pairs settled by their boxes never reach points.
    """
    by, side = list(by), link_side(distance)
    p = _xyz(points, by, x, y, z, "point_id")
    positions = p.groupBy(*by, *AXES).agg(F.min("point_id").alias("w"))
    positions = session.cut_lineage(_fine(positions, side))
    roots = [f"r{s}{a}" for s in "ab" for a in AXES]

    def settle(pairs: DataFrame) -> DataFrame:
        linked = pairs.where(F.col("kind") == "full").select(*by, *roots).distinct()
        open_ = pairs.where(F.col("kind") != "full").join(linked, [*by, *roots], "left_anti")
        return pairs.where(F.col("kind") == "full").unionByName(open_)

    found = _refine(positions, by, side, distance, _offsets(2, half=True), leaf_pairs, root=True, settle=settle)
    full = found.where(F.col("kind") == "full").select(*by, *roots)
    near = _leaf_points(found, positions, by, distance, *roots).select(*by, *roots)
    edges = full.unionByName(near).distinct()
    nodes = positions.groupBy(*by, *[_level(a, 0).alias(f"k{a}") for a in AXES]).agg(F.min("w").alias("node"))
    for s in "ab":
        named = nodes.select(*by, *[F.col(f"k{a}").alias(f"r{s}{a}") for a in AXES], F.col("node").alias(f"_{s}"))
        edges = edges.join(named, [*by, *[f"r{s}{a}" for a in AXES]])
    return edges.select(*by, F.least("_a", "_b").alias("node_a"), F.greatest("_a", "_b").alias("node_b"))


# --- nearest point -----------------------------------------------------------------------------

def pyramid(boxes: DataFrame, by: list[str], dims: Sequence[str], fan: int = 8, levels: int | None = None) -> list[DataFrame]:
    """Boxes ``by..., k*, lo*, hi*`` and ever coarser ones, the last with at most two boxes per cloud and dimension.

    Cells that are less than ``fan ** n`` apart fall into one coarse cell or two neighbours after ``n`` steps. All but the
    finest are stored; those of few rows are marked for broadcast.
    """
    if levels is None:
        spans = boxes.groupBy(*by).agg(*[(F.max(f"k{a}") - F.min(f"k{a}")).alias(f"k{a}") for a in dims])
        width = max((v for v in spans.agg(*[F.max(f"k{a}") for a in dims]).first() if v is not None), default=0)
        levels = 1
        while fan ** (levels - 1) < width:
            levels += 1
    grids = [boxes]
    for _ in range(levels - 1):
        up = grids[-1].withColumns({f"k{a}": F.floor(F.col(f"k{a}") / fan).cast("long") for a in dims})
        grids.append(session.sized(up.groupBy(*by, *[f"k{a}" for a in dims]).agg(
            *[F.min(f"lo{a}").alias(f"lo{a}") for a in dims], *[F.max(f"hi{a}").alias(f"hi{a}") for a in dims])))
    return grids


def _halvings(targets: DataFrame, by: list[str], dims: Sequence[str], side: float, fan: int) -> int:
    """How often cells of ``side`` are cut by ``fan`` until none that holds several places is fuller than ``LEAF_ROWS``."""
    spread = F.lit(False)
    for a in dims:
        spread = spread | (F.col(f"lo{a}") < F.col(f"hi{a}"))
    for cuts in range(MAX_CUTS):
        fullest = _boxes(targets, by, dims, side / fan ** cuts).where(spread).agg(F.max("m")).first()[0]
        if (fullest or 0) <= LEAF_ROWS:
            return cuts
    return MAX_CUTS


def _boxes(targets: DataFrame, by: list[str], dims: Sequence[str], side: float) -> DataFrame:
    """Occupied cells ``by..., k*`` with their box ``lo*, hi*`` and number of points ``m``."""
    return targets.groupBy(*by, *[cell(a, side).alias(f"k{a}") for a in dims]).agg(
        F.count(F.lit(1)).alias("m"), *[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in dims])


def _leaf_rows(targets: DataFrame, wanted: DataFrame, keys: list[str], dims: Sequence[str]) -> DataFrame:
    """``keys, _rows``: the places in the cells of ``wanted``, each with its point of the least id; only these are exchanged."""
    rest = [a for a in AXES if a not in dims]
    held = session.attach(targets, wanted.select(*keys).distinct(), keys, "left_semi")
    held = held.groupBy(*keys, *dims).agg(F.min(F.struct("point_id", *rest) if rest else F.col("point_id")).alias("_one"))
    own = ["_one.point_id", *[f"_one.{a}" for a in rest]] if rest else [F.col("_one").alias("point_id")]
    held = held.select(*keys, *dims, *own)
    return held.groupBy(*keys).agg(F.collect_list(F.struct(*AXES, "point_id")).alias("_rows"))


def nearest_join(queries: DataFrame, targets: DataFrame, by: Sequence[str] = BY, query: str = "q_id",
                 x: str = "x", y: str = "y", z: str = "z", side: float = 1.0, levels: int | None = None, fan: int = 2,
                 metric: str = "3d") -> DataFrame:
    """``by..., query, dist, nx, ny, nz, n_id``: the target nearest to each query (least id on ties).

    Targets are boxed on grids of sides ``side * fan^level``, as many as it takes until a cloud has
    at most eight boxes, or ``levels``; full cells are cut further, until few places are left in each. Each query first
    goes down to the nearest box of every grid, and the nearest point there bounds its distance. Then it goes down to all
    boxes that reach into that distance, and meets their points. No step orders the boxes of a query, grids of few
    rows are broadcast, and a box's points are one row. ``metric="vertical"`` looks for the
    nearest in plan and reports the height difference. Queries in a cloud without targets have no
    row.
    """
    by = list(by)
    flat = metric == "vertical"
    if metric not in ("3d", "vertical"):
        raise ValueError("metric must be '3d' or 'vertical'")
    dims = AXES[:2] if flat else AXES
    t = _xyz(targets, by, x, y, z, "point_id")
    cuts = _halvings(t, by, dims, side, fan)
    fine = side / fan ** cuts
    boxes = session.cut_lineage(_boxes(t, by, dims, fine).drop("m"))
    t = t.withColumns({f"k{a}": cell(a, fine) for a in dims})
    grids = pyramid(boxes, by, dims, fan, levels and levels + cuts)
    small = [session.is_small(g) for g in grids]
    grids[0] = F.broadcast(boxes) if small[0] else boxes
    q = _xyz(queries, by, x, y, z, query).select(*by, query, *[F.col(a).alias(f"q{a}") for a in AXES])
    keys, ups = [f"k{a}" for a in dims], [f"u{a}" for a in dims]

    def square(gaps: list[Column]) -> Column:
        total = F.lit(0.0)
        for g in gaps:
            total = total + g * g
        return total

    def reach(lo: Column, hi: Column, at: Column) -> Column:
        return F.greatest(lo - at, at - hi, F.lit(0.0))

    def apart(row: Column) -> Column:
        return square([row[a] - F.col(f"q{a}") for a in dims])

    # One box of each grid, the children of a box as one row. The work is in the boxes met, so few queries are spread as well.
    spread = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = q.repartition(spread, *by, query)
    for level in range(len(grids) - 1, -1, -1):
        top = level == len(grids) - 1
        kids = grids[level] if top else grids[level].withColumns({u: F.floor(F.col(k) / fan).cast("long") for u, k in zip(ups, keys)})
        on = by if top else [*by, *ups]
        kids = kids.groupBy(*on).agg(F.collect_list(F.struct(*keys, *[f"{n}{a}" for n in ("lo", "hi") for a in dims])).alias("_kids"))
        ends = ends.join(F.broadcast(kids) if small[level] else kids, on)
        near = F.array_min(F.transform("_kids", lambda c: F.struct(
            square([reach(c[f"lo{a}"], c[f"hi{a}"], F.col(f"q{a}")) for a in dims]).alias("least"), *[c[k].alias(k) for k in keys])))
        # Behind a generator, so that tests on the keys do not repeat the search for the least.
        ends = ends.select(*by, query, "qx", "qy", "qz", F.inline(F.array(near))).drop("least")
        ends = ends.withColumnsRenamed(dict(zip(keys, ups))) if level else ends
    ends = session.cut_lineage(ends)
    bound = ends.join(_leaf_rows(t, ends, [*by, *keys], dims), [*by, *keys]).select(
        *by, query, "qx", "qy", "qz", F.array_min(F.transform("_rows", apart)).alias("_bound"))

    # All boxes that reach into the distance found.
    bound = bound.repartition(spread, *by, query)
    least = square([reach(F.col(f"lo{a}"), F.col(f"hi{a}"), F.col(f"q{a}")) for a in dims])
    frontier = session.cut_lineage(bound)
    for level in range(len(grids) - 1, -1, -1):
        if level == len(grids) - 1:
            frontier = frontier.join(grids[level], by)
        else:
            child = grids[level].withColumns({u: F.floor(F.col(k) / fan).cast("long") for u, k in zip(ups, keys)})
            frontier = frontier.join(child, [*by, *ups])
        frontier = frontier.where(least <= F.col("_bound"))
        frontier = frontier.select(*by, query, "qx", "qy", "qz", "_bound", *[F.col(k).alias(u if level else k) for u, k in zip(ups, keys)])
    frontier = session.cut_lineage(frontier)
    met = frontier.join(_leaf_rows(t, frontier, [*by, *keys], dims), [*by, *keys])
    first = F.array_min(F.transform("_rows", lambda p: F.struct(
        apart(p).alias("d2"), p["point_id"].alias("n_id"), (F.col("qz") - p["z"]).alias("drop"), *[p[a].alias(a) for a in AXES])))
    met = met.select(*by, query, "_bound", F.inline(F.array(first))).where(F.col("d2") <= F.col("_bound"))
    near = met.groupBy(*by, query).agg(F.min(F.struct("d2", "n_id", "drop", *AXES)).alias("b"))
    dist = F.col("b.drop") if flat else F.sqrt("b.d2")
    return near.select(*by, query, dist.alias("dist"), F.col("b.x").alias("nx"), F.col("b.y").alias("ny"),
                       F.col("b.z").alias("nz"), F.col("b.n_id").alias("n_id"))
