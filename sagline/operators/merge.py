"""Joining broken pieces of a wire.

Each pass looks at segments from the largest down. A seed takes, in that order, every later segment
whose height and plan position agree with it and whose points lie on its parabola, refitting the
parabola after each take. Plan and height tests depend only on the seed and the candidate, so they
form a graph, and pieces of the graph cannot affect each other. A cloud with few points is scanned in one task, which
finds each seed's candidates as it comes to it, and a larger cloud where most segments are candidates of most seeds in
runs of its order, one after the other: a run of segments is affected only by the seeds before it, so it needs their power
sums alone. Other clouds are cut into the pieces of their graph, and a piece with few points is scanned in one task. A larger piece is scanned in rounds by depth of the seed order: all seeds that no earlier seed
can still affect go ahead at once. A seed whose candidates have few points makes its whole ordered scan in that round,
in a task of its own; one with more takes its next segment with the points distributed. Only power sums per segment
move between rounds. All ways solve for the parabola from power sums by the same formula, where a seed
with fewer than three distinct places has none and takes nothing, so all give the order-by-order result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagline import session
from sagline.functions import moments as M
from sagline.functions.geometry import real_points
from sagline.functions.models import catenary_offset
from sagline.operators.catenary import OFFSET_START, fit_catenary_offset
from sagline.operators.cluster import connected_components
from sagline.operators.fit import frames
from sagline.operators.segments import absorb_points, append_segments, drop_absorbed, rank_segments, rerank_after_merge
from sagline.operators.shape import principal_axis

BY = ("cloud_id",)
# Clouds, pieces of the gate graph or seeds with at most this many points to scan, and as many edges, are scanned in one task.
SCAN_ROWS = 1_000_000
# A difference of means this close to a gate's limit is at the limit, which does not pass; rounding does not decide it.
TIE = 1e-9
# Clouds with more gates than this, or more for each segment, are never written as a graph: where each seed waits for most of those
# before it, rounds would settle a few seeds each. So many segments of each cloud are paired to estimate its gates.
GATE_ROWS = 20_000_000
GATE_DEGREE = 100
GATE_SAMPLE = 300
# Candidates that a seed, or seeds that a segment of more than ``SCAN_ROWS`` points, tests at once, at first.
TEST_ROWS = 16
# About so many points of such a segment rule seeds out before all are met.
FEW_ROWS = 1000


def segment_frames(points: DataFrame, by: Sequence[str] = BY, x: str = "x", y: str = "y", z: str = "z",
                   azimuth: bool = False) -> DataFrame:
    """Moments, frame and plan line ``slope`` of every segment."""
    g = frames(points, [*by, "seg_id"], x, y, z, azimuth)
    return g.withColumn("slope", F.when(F.col("m200") > 0, F.col("m110") / F.col("m200")))


def merge_gate_join(segments: DataFrame, line: float = 0.5, height: float = 4.0, seed: int = 10,
                    by: Sequence[str] = BY) -> DataFrame:
    """``by..., a, b, oa, ob``: seeds and the later segments that pass the plan and height tests.

    ``segments`` has ``seg_id, ord, n, mx, my, mz, slope``. A seed's plan line is laid over a grid of
    tiles and only meets segments whose mean lies in a tile it crosses.
    """
    by = list(by)
    s = segments.select(*by, "seg_id", F.col("ord").cast("long").alias("o"), "n", "mx", "my", "mz", "slope")
    area = s.groupBy(*by).agg(F.min("mx").alias("_x0"), F.max("mx").alias("_x1"), F.min("my").alias("_y0"),
                              F.max("my").alias("_y1"), F.count(F.lit(1)).alias("_count"))
    cuts = F.greatest(F.lit(1.0), F.least(F.lit(256.0), F.ceil(F.sqrt("_count")).cast("double")))
    area = area.withColumn("_g", cuts)
    wide, tall = (F.col("_x1") - F.col("_x0")) / F.col("_g"), (F.col("_y1") - F.col("_y0")) / F.col("_g")
    area = area.select(*by, "_x0", "_y0", "_y1", "_g", F.when(wide > 0, wide).otherwise(1.0).alias("_w"),
                       F.when(tall > 0, tall).otherwise(1.0).alias("_h"))
    s = session.attach(s, area, by)

    def row(v: Column) -> Column:
        return F.floor((v - F.col("_y0")) / F.col("_h")).cast("long")

    b = s.select(*by, F.col("seg_id").alias("b"), F.col("o").alias("ob"), F.col("mx").alias("bx"), F.col("my").alias("by_"),
                 F.col("mz").alias("bz"), F.floor((F.col("mx") - F.col("_x0")) / F.col("_w")).cast("long").alias("tx"),
                 row(F.col("my")).alias("ty"), F.floor(F.col("mz") / height).cast("long").alias("tz"))
    a = s.where((F.col("n") >= seed) & F.col("slope").isNotNull())
    a = a.withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g").cast("long"))))
    left = F.col("my") + F.col("slope") * (F.col("_x0") + F.col("tx") * F.col("_w") - F.col("mx"))
    right = left + F.col("slope") * F.col("_w")
    slack = line * 1.001 + 1e-6
    a = a.withColumns({"_lo": F.greatest(F.least(left, right) - slack, F.col("_y0")),
                       "_hi": F.least(F.greatest(left, right) + slack, F.col("_y1"))}).where("_lo <= _hi")
    a = a.withColumn("ty", F.explode(F.sequence(row(F.col("_lo")), row(F.col("_hi")))))
    a = a.withColumn("tz", F.explode(F.array(*[F.floor(F.col("mz") / height).cast("long") + i for i in (-1, 0, 1)])))
    a = a.select(*by, F.col("seg_id").alias("a"), F.col("o").alias("oa"), "mx", "my", "mz", "slope", "tx", "ty", "tz")
    off = F.abs(F.col("my") + F.col("slope") * (F.col("bx") - F.col("mx")) - F.col("by_"))
    return (a.join(b, [*by, "tx", "ty", "tz"])
            .where((F.col("oa") < F.col("ob")) & (off < line - TIE) & (F.abs(F.col("mz") - F.col("bz")) < height - TIE))
            .select(*by, "a", "b", "oa", "ob"))


# --- scan in one task ---------------------------------------------------------------------------

def _take(frame: tuple[float, ...], sums: np.ndarray, candidates: np.ndarray, xyz: dict[int, np.ndarray], gone: set[int],
          curve: float) -> list[int]:
    """The candidates one seed takes, in order, from its power sums about ``frame``; they are added to ``gone``."""
    mx, my, mz, c, s = frame
    p, taken = _solve(sums), []
    for b in candidates:
        if b in gone or p is None:
            continue
        q = xyz[b]
        bu, bv = (q[:, 0] - mx) * c + (q[:, 1] - my) * s, q[:, 2] - mz
        u = bu - p[0]
        if np.abs((p[2] * u + p[3]) * u + p[4] + p[1] - bv).max() < curve:
            taken.append(b)
            gone.add(b)
            sums = sums + _power_sums(bu, bv)
            p = _solve(sums)
    return taken


class _Run:
    """Segments of one run of the order with their points, taken by seeds as :func:`_take` does, gates included."""

    def __init__(self, points: pd.DataFrame, segs: pd.DataFrame, line: float, curve: float, height: float) -> None:
        self.line, self.curve, self.height = line, curve, height
        self.segs = segs.sort_values("o")
        self.ids = self.segs["seg_id"].to_numpy()
        self.mean = self.segs[["mx", "my", "mz"]].to_numpy(np.float64)
        self.alive = np.arange(len(self.ids))
        by_id = np.argsort(self.ids)
        at = by_id[np.searchsorted(self.ids[by_id], points["seg_id"].to_numpy())]
        order = np.argsort(at, kind="stable")
        self.xyz = points[["x", "y", "z"]].to_numpy(np.float64)[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.ids) + 1))
        # A segment whose highest or lowest point is off the curve is off it.
        size, z = np.diff(self.start), self.xyz[:, 2]
        by_z = np.lexsort((z, at[order]))
        self.ends = self.xyz[np.stack([by_z[self.start[:-1]], by_z[self.start[:-1] + size - 1]], 1)] if len(z) else np.zeros((0, 2, 3))

    def own(self, i: int) -> np.ndarray:
        return self.xyz[self.start[i]:self.start[i + 1]]

    def take(self, frame: tuple[float, ...], slope: float, sums: np.ndarray, after: int) -> tuple[list[int], np.ndarray]:
        """Places of the segments behind ``after`` that a seed takes, in order, and its sums with theirs."""
        mx, my, mz, c, s = frame
        self.alive = self.alive[np.searchsorted(self.alive, after, "right"):]
        m = self.mean[self.alive]
        gate = (np.abs(my + slope * (m[:, 0] - mx) - m[:, 1]) < self.line - TIE) & (np.abs(mz - m[:, 2]) < self.height - TIE)
        cand, taken = self.alive[gate], []
        p = _solve(sums) if len(cand) else None
        if p is None:
            return taken, sums

        def miss(q: np.ndarray) -> np.ndarray:
            u = (q[..., 0] - mx) * c + (q[..., 1] - my) * s - p[0]
            return np.abs((p[2] * u + p[3]) * u + p[4] + p[1] - (q[..., 2] - mz))

        k, width = 0, TEST_ROWS
        while k < len(cand) and p is not None:
            part = cand[k:k + width]
            for j in np.flatnonzero((miss(self.ends[part]) < self.curve).all(1)):
                q = self.own(part[j])
                if miss(q).max() < self.curve:
                    taken.append(int(part[j]))
                    sums = sums + _power_sums((q[:, 0] - mx) * c + (q[:, 1] - my) * s, q[:, 2] - mz)
                    p = _solve(sums)
                    k, width = k + int(j) + 1, TEST_ROWS
                    break
            else:
                k, width = k + width, width * 4
        if taken:
            self.alive = np.setdiff1d(self.alive, taken, assume_unique=True)
        return taken, sums


FRAME = ("mx", "my", "mz", "c", "s")


def _scan_run(points: pd.DataFrame, segs: pd.DataFrame, keys: list[str], line: float, curve: float, height: float, seed: int) -> pd.DataFrame:
    """One run of a cloud's order: rows ``into, seg_id`` of what was taken, and of each seed left, ``seg_id`` null, its sums.

    Rows of ``segs`` that are ``held`` are seeds of earlier runs with their sums.
    """
    held = segs[segs["held"]].sort_values("o")
    # The seeds before this run go first; alive segments of the run are still behind them all.
    run = _Run(points, segs[~segs["held"]], line, curve, height)
    pairs, left = [], []

    def kept(o: int, a: int, frame: tuple[float, ...], slope: float, sums: np.ndarray) -> None:
        left.append((o, a, *frame, slope, *sums))

    for o, a, frame, slope, sums in zip(held["o"], held["seg_id"], held[list(FRAME)].to_numpy(), held["slope"], held[list(KEEP)].to_numpy(np.float64)):
        taken, sums = run.take(tuple(frame), slope, sums, -1)
        pairs += [(a, run.ids[b]) for b in taken]
        kept(o, a, frame, slope, sums)
    own = run.segs
    open_ = (own["n"].to_numpy() >= seed) & own["slope"].notna().to_numpy()
    gone = np.ones(len(own), bool)
    gone[run.alive] = False
    for i, (o, a, slope) in enumerate(zip(own["o"], own["seg_id"], own["slope"])):
        if gone[i] or not open_[i]:
            continue
        frame = tuple(own[list(FRAME)].iloc[i])
        mx, my, mz, c, s = frame
        q = run.own(i)
        taken, sums = run.take(frame, slope, _power_sums((q[:, 0] - mx) * c + (q[:, 1] - my) * s, q[:, 2] - mz), i)
        gone[taken] = True
        pairs += [(a, run.ids[b]) for b in taken]
        kept(o, a, frame, slope, sums)
    # Nullable integers, as ids may exceed what a double tells apart.
    out = pd.concat([pd.DataFrame(pairs, columns=["into", "seg_id"]).astype("Int64").assign(o=pd.array([pd.NA] * len(pairs), "Int64")),
                     pd.DataFrame(left, columns=["o", "into", *FRAME, "slope", *KEEP]).astype({"o": "Int64", "into": "Int64"}).assign(
                         seg_id=pd.array([pd.NA] * len(left), "Int64"))])
    for k in keys:
        out[k] = segs[k].iloc[0]
    return out[[*keys, "into", "seg_id", "o", *FRAME, "slope", *KEEP]]


def _large_order(segs: DataFrame, by: list[str], scan_rows: int) -> DataFrame:
    """``segs`` with its ``run``: about ``scan_rows`` points of the order and one segment more at most, or one ``large`` segment alone."""
    order = Window.partitionBy(*by).orderBy("o")
    large = F.col("n") > max(scan_rows, 1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    segs = segs.withColumns({"large": large, "_left": F.sum(large.cast("int")).over(upto), "_n": F.sum(F.when(large, 0).otherwise(F.col("n"))).over(upto)})
    place = ["_left", F.when(F.col("large"), -1).otherwise(F.floor((F.col("_n") - 1) / max(scan_rows, 1)))]
    return segs.withColumn("run", F.dense_rank().over(Window.partitionBy(*by).orderBy(*place)) - 1).drop("_left", "_n")


def _misses(points: DataFrame, tests: DataFrame, by: list[str]) -> DataFrame:
    """``by..., into, o, worst``: how far the points of a cloud's segment are off each curve of ``tests`` at most."""
    p = session.attach(points.select(*by, "x", "y", "z"), tests, by)
    u = (F.col("x") - F.col("mx")) * F.col("c") + (F.col("y") - F.col("my")) * F.col("s") - F.col("um")
    miss = F.abs((F.col("q2") * u + F.col("q1")) * u + F.col("q0") + F.col("vm") - (F.col("z") - F.col("mz")))
    return p.groupBy(*by, "into", "o").agg(F.max(miss).alias("worst"))


def _takers(points: DataFrame, mine: DataFrame, held: DataFrame, by: list[str], line: float, curve: float, height: float) -> DataFrame:
    """``by..., into``: the first of the seeds ``held`` that takes its cloud's segment in ``mine``, with the points left where they are."""
    own = points.select(*by, "seg_id", "x", "y", "z").join(F.broadcast(mine.select(*by, "seg_id", F.col("n").alias("_all"))), [*by, "seg_id"])
    to = mine.select(*by, *[F.col(c).alias(f"_{c}") for c in ("mx", "my", "mz")])
    off = F.abs(F.col("my") + F.col("slope") * (F.col("_mx") - F.col("mx")) - F.col("_my"))
    met = _curves(held.join(F.broadcast(to), by).where((off < line - TIE) & (F.abs(F.col("mz") - F.col("_mz")) < height - TIE)))
    left = session.cut_lineage(met.where("q2 IS NOT NULL").select(*by, "into", "o", *FRAME, "um", "vm", "q2", "q1", "q0"))
    # Its highest and lowest point and a few others rule most curves out.
    some = own.where(F.pmod(F.xxhash64("x", "y", "z"), F.ceil(F.col("_all") / FEW_ROWS)) == 0).select(*by, "x", "y", "z")
    ends = own.groupBy(*by).agg(*[f(F.struct("z", "x", "y")).alias(n) for f, n in ((F.min, "_low"), (F.max, "_high"))])
    few = append_segments(some, *[ends.select(*by, f"{e}.x", f"{e}.y", f"{e}.z") for e in ("_low", "_high")])
    key, found, width = [*by, "into"], [], TEST_ROWS
    while not session.is_empty(left):
        if not found:
            left = session.cut_lineage(left.join(_misses(session.cut_lineage(few), left, by).where(F.col("worst") < curve), [*key, "o"], "left_semi"))
        part = session.cut_lineage(left.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).where(F.col("_k") <= width).drop("_k"))
        hit = _misses(own, part, by).where(F.col("worst") < curve).groupBy(*by).agg(F.min(F.struct("o", "into")).alias("h"))
        found.append(session.cut_lineage(hit.select(*by, F.col("h.into").alias("into"))))
        left = session.cut_lineage(left.join(part, key, "left_anti").join(found[-1], by, "left_anti"))
        width *= 4
    return append_segments(*found) if found else left.select(*key)


def _take_large(points: DataFrame, mine: DataFrame, held: DataFrame | None, by: list[str], line: float, curve: float, height: float,
                seed: int) -> tuple[DataFrame | None, DataFrame]:
    """``by..., into, seg_id`` of the segments in ``mine``, one a cloud, that seeds take, and the seeds with what they took and those left."""
    key = [*by, "into"]
    fresh = mine.where((F.col("n") >= seed) & F.col("slope").isNotNull()).withColumn("into", F.col("seg_id"))
    fresh = fresh.select(*key, "o", *FRAME, "slope", *[c.cast("double").alias(k) for c, k in zip(_profile(), KEEP)])
    if held is None:
        return None, session.cut_lineage(fresh)
    hit = _takers(points, mine, held, by, line, curve, height)
    added = hit.join(held.select(*key, *FRAME), key).join(mine.select(
        *by, *[F.col(c).alias(f"_b{c[1]}") for c in ("mx", "my", "mz")], "n", *[M.name(e) for e in M.SPATIAL]), by)
    d = F.expr("(_bx - mx) * c + (_by - my) * s").alias("_d")
    added = added.select(*key, d, (F.col("_bz") - F.col("mz")).alias("_dz"), *_profile())
    added = added.select(*key, *[F.expr(e).alias(f"_{n}") for n, e in _shifted("_d", "_dz").items()])
    grown = held.join(added, key, "left").withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0.0)) for n in KEEP})
    kept = grown.select(*fresh.columns).unionByName(fresh.join(hit, by, "left_anti"))
    return hit.join(mine.select(*by, "seg_id"), by), session.cut_lineage(kept)


def _scan_order(points: DataFrame, seg: DataFrame, by: list[str], line: float, curve: float, height: float, seed: int,
                scan_rows: int) -> DataFrame:
    """Accepted pairs of whole clouds, in runs of about ``scan_rows`` points and one segment more at most, one after the other.

    A segment with more points is a run of its own; its sums are known, and its points are tested where they are."""
    schema = T.StructType([*[f for f in seg.schema if f.name in by], *[T.StructField(c, T.LongType()) for c in ("into", "seg_id", "o")],
                           *[T.StructField(c, T.DoubleType()) for c in (*FRAME, "slope", *KEEP)]])
    # The order is a window over one row per segment.
    segs = seg.select(*by, "seg_id", F.col("ord").cast("long").alias("o"), "n", *FRAME, "slope", F.lit(False).alias("held"))
    segs = session.cut_lineage(_large_order(segs, by, scan_rows))
    runs = {r["run"]: (r["small"], r["large"]) for r in segs.groupBy("run").agg(F.max(~F.col("large")).alias("small"), F.max("large").alias("large")).collect()}
    found, held = [seg.select(*by, F.col("seg_id").alias("into"), "seg_id").limit(0)], None
    for run in sorted(runs):
        small, large = runs[run]
        if small:
            mine = segs.where((F.col("run") == run) & ~F.col("large")).drop("run", "large").withColumns(
                {c: F.lit(None).cast("double") for c in KEEP if c != "n"})
            rows = session.attach(points.select(*by, "seg_id", "x", "y", "z"), mine.select(*by, "seg_id"), [*by, "seg_id"], "left_semi")
            if held is not None:
                mine = mine.withColumn("n", F.col("n").cast("double")).unionByName(held.select(
                    *by, F.col("into").alias("seg_id"), "o", *FRAME, "slope", *KEEP, F.lit(True).alias("held")))
            mine = mine.select(*[F.col(c).alias(c) for c in mine.columns])
            out = rows.groupBy(*by).cogroup(mine.groupBy(*by)).applyInPandas(
                lambda p, e: _scan_run(p, e, by, line, curve, height, seed), schema)
            out = session.cut_lineage(out)
            found.append(out.where(F.col("seg_id").isNotNull()).select(*by, "into", "seg_id"))
            held = out.where(F.col("seg_id").isNull()).drop("seg_id")
        if large:
            mine = segs.where((F.col("run") == run) & F.col("large")).select(*by, "seg_id", "o")
            mine = session.cut_lineage(mine.join(seg, [*by, "seg_id"]))
            hit, held = _take_large(points, mine, held, by, line, curve, height, seed)
            found += [] if hit is None else [session.cut_lineage(hit.select(*by, "into", "seg_id"))]
    return append_segments(*found)


def _crowded(seg: DataFrame, by: list[str], line: float, height: float, seed: int) -> DataFrame:
    """Clouds with more gates than ``GATE_ROWS`` or, for each segment, ``GATE_DEGREE``, by their share among pairs of a sample of segments."""
    every = F.ceil(F.col("_count") / GATE_SAMPLE)
    counts = seg.groupBy(*by).agg(F.count(F.lit(1)).alias("_count"))
    some = session.attach(seg, counts, by).where(F.pmod(F.xxhash64("seg_id"), every) == 0)
    some = session.cut_lineage(some.select(*by, "_count", "seg_id", "ord", "n", "mx", "my", "mz", "slope"))
    a, b = (some.select(*by, "_count", *[F.col(c).alias(f"{p}_{c}") for c in ("ord", "n", "mx", "my", "mz", "slope")]) for p in "ab")
    off = F.abs(F.col("a_my") + F.col("a_slope") * (F.col("b_mx") - F.col("a_mx")) - F.col("b_my"))
    passes = (F.col("a_n") >= seed) & (off < line) & (F.abs(F.col("a_mz") - F.col("b_mz")) < height)
    met = a.join(b.drop("_count"), by).where("a_ord < b_ord")
    degree = F.avg(F.coalesce(passes.cast("double"), F.lit(0.0))) * F.max("_count") / 2
    met = met.groupBy(*by).agg(degree.alias("_degree"), F.max("_count").alias("_count"))
    return session.cut_lineage(met.where((F.col("_degree") > GATE_DEGREE) | (F.col("_degree") * F.col("_count") > GATE_ROWS)).select(*by))


def _by_segment(points: pd.DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray, pd.DataFrame]:
    """Coordinates by segment, the segments, and the first row of each."""
    points = points.sort_values("seg_id", kind="stable")
    ids, first = np.unique(points["seg_id"].to_numpy(), return_index=True)
    return dict(zip(ids, np.split(points[["x", "y", "z"]].to_numpy(), first[1:]))), ids, points.iloc[first]


def _pairs(taken: list[tuple[int, int]], edges: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(taken, columns=["into", "seg_id"], dtype="int64")
    for k in keys:
        out[k] = edges[k].iloc[0] if len(edges) else None
    return out[[*keys, "into", "seg_id"]]


def _scan(points: pd.DataFrame, edges: pd.DataFrame, keys: list[str], curve: float) -> pd.DataFrame:
    """Accepted (seed, candidate) pairs of one bounded piece of the gate graph, in order."""
    xyz, ids, one = _by_segment(points)
    frame = dict(zip(ids, one[["mx", "my", "mz", "c", "s"]].to_numpy()))
    edges = edges.sort_values(["oa", "ob"])
    seeds, start = np.unique(edges["oa"].to_numpy(), return_index=True)
    candidates = np.split(edges["b"].to_numpy(), start[1:]) if len(seeds) else []
    gone: set[int] = set()
    taken = []
    for a, mine in zip(edges["a"].to_numpy()[start], candidates):
        if a in gone:
            continue
        mx, my, mz, c, s = frame[a]
        q = xyz[a]
        sums = _power_sums((q[:, 0] - mx) * c + (q[:, 1] - my) * s, q[:, 2] - mz)
        taken += [(a, b) for b in _take(frame[a], sums, mine, xyz, gone, curve)]
    return _pairs(taken, edges, keys)


def _scan_seed(points: pd.DataFrame, edges: pd.DataFrame, keys: list[str], curve: float) -> pd.DataFrame:
    """Accepted pairs of one seed whose sums come with its edges; ``points`` are its candidates'."""
    xyz, _, _ = _by_segment(points)
    edges = edges.sort_values("ob")
    own = edges.iloc[0]
    sums = own[list(KEEP)].to_numpy(np.float64)
    found = _take(tuple(own[["mx", "my", "mz", "c", "s"]]), sums, edges["b"].to_numpy(), xyz, set(), curve)
    return _pairs([(own["a"], b) for b in found], edges, keys)


def _power_sums(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The columns ``KEEP``; those of several segments add up."""
    return np.array([*[(u ** i).sum() for i in range(5)], v.sum(), (u * v).sum(), (u * u * v).sum()])


def _solve(sums: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """``um, vm, q2, q1, q0`` as :func:`_curves` finds them, None where it finds none."""
    n = sums[0]
    um, vm = sums[1] / n, sums[5] / n
    k = [sum(math.comb(i, j) * sums[j] * (-um) ** (i - j) for j in range(i + 1)) for i in range(5)]
    w = [sum(math.comb(i, j) * (sums[5 + j] - vm * sums[j]) * (-um) ** (i - j) for j in range(i + 1)) for i in range(3)]
    if n < 2 or not k[2] > 0:
        return None
    sd = math.sqrt(k[2] / (n - 1))
    k2, k3, k4 = (k[i] / sd ** i for i in (2, 3, 4))
    den = k4 - k3 * k3 / k2 - k2 * k2 / n
    if not den > M.DISTINCT * k4:
        return None
    q2 = (w[2] / sd ** 2 - k3 * (w[1] / sd) / k2) / den
    return um, vm, q2 / sd ** 2, (w[1] / sd - k3 * q2) / k2 / sd, -k2 * q2 / n


# --- scan in rounds -----------------------------------------------------------------------------

KEEP = ("n", "k1", "k2", "k3", "k4", "v0", "v1", "v2")


# Sums along direction (c, s) about a segment's own mean, as SQL text.
PROFILE = {"k1": "0D", **{f"k{i}": M.directed(i, 0) for i in (2, 3, 4)},
           "v0": "0D", "v1": M.directed(1, 1), "v2": M.directed(2, 1)}


def _profile(*extra: str) -> list[Column]:
    return [F.col("n"), *[F.expr(e).alias(n) for n, e in PROFILE.items()], *[F.col(c) for c in extra]]


def _shifted(d: str, dz: str) -> dict[str, str]:
    """The columns ``KEEP`` about a point ``d`` behind and ``dz`` below their origin, as SQL text."""
    def total(terms: list[str], power: int) -> str:
        return " + ".join(f"{float(math.comb(power, j))}D * {t} * {M.product([d], [power - j])}" for j, t in enumerate(terms))

    k = ["n", "k1", "k2", "k3", "k4"]
    out = {"n": "n", **{f"k{i}": total(k[:i + 1], i) for i in range(1, 5)}}
    for i in range(3):
        out[f"v{i}"] = total([f"(v{j} + {dz} * {k[j]})" for j in range(i + 1)], i)
    return out


def _curves(model: DataFrame) -> DataFrame:
    """Current parabola of each seed: ``um, vm, q2, q1, q0``."""
    m = model.withColumns({"um": F.col("k1") / F.col("n"), "vm": F.col("v0") / F.col("n")})
    m = m.withColumns({f"_{c}": F.expr(e) for c, e in _shifted("(-um)", "(-vm)").items()})
    m = M.parabola(m, "n", "_k2", "_k3", "_k4", "_v1", "_v2", "0D", scaled=False)
    return m.drop(*[f"_{c}" for c in KEEP])


def _ready_seeds(edges: DataFrame, seg: DataFrame, by: list[str], scan_rows: int) -> DataFrame:
    """``by..., a, whole``: seeds that nothing earlier can still affect; ``whole`` if their candidates fit one task.

    Such a seed is the first open seed of all its candidates and itself nobody's candidate.
    """
    first = edges.groupBy(*by, "b").agg(F.min("oa").alias("first"))
    sized = seg.select(*by, F.col("seg_id").alias("b"), F.col("n").alias("_rows"))
    met = edges.join(first, [*by, "b"]).join(sized, [*by, "b"])
    ready = met.groupBy(*by, "a").agg(F.min(F.col("oa") == F.col("first")).alias("_ok"), F.sum("_rows").alias("_rows"),
                                      F.count(F.lit(1)).alias("_tests")).where("_ok")
    ready = ready.join(first.select(*by, F.col("b").alias("a")), [*by, "a"], "left_anti")
    return ready.select(*by, "a", ((F.col("_rows") <= scan_rows) & (F.col("_tests") <= scan_rows)).alias("whole"))


def _scan_rounds(points: DataFrame, seg: DataFrame, edges: DataFrame, by: list[str], curve: float, scan_rows: int) -> DataFrame:
    """:func:`_scan` by depth, with the points left where they are. ``seg`` are segment frames.

    A seed that is ready and small is settled in one round, so rounds follow the longest run of seeds that wait
    for each other and are not taken. Points are written anew whenever half of them have no edge left.
    """
    frame = seg.select(*by, F.col("seg_id").alias("a"), *_profile("mx", "my", "mz", "c", "s"))
    model = session.cut_lineage(frame.join(edges.select(*by, "a").distinct(), [*by, "a"], "left_semi"))
    edges, taken = session.cut_lineage(edges), []
    schema = T.StructType([*[f for f in edges.schema if f.name in by], T.StructField("into", T.LongType()), T.StructField("seg_id", T.LongType())])
    weight, key = seg.select(*by, F.col("seg_id").alias("b"), "n"), [*by, "a"]
    held = None
    while True:
        left = edges.select(*by, "b").distinct()
        rows = left.join(weight, [*by, "b"]).agg(F.sum("n")).first()[0]
        if not rows:
            break
        if held is None or 2 * rows <= held:
            points, held = session.cut_lineage(points.join(left.withColumnRenamed("b", "seg_id"), [*by, "seg_id"], "left_semi")), rows
        ready = session.cut_lineage(_ready_seeds(edges, seg, by, scan_rows))
        kinds = {r["whole"] for r in ready.select("whole").distinct().collect()}
        gone, upto = [], ready.select(*key, F.when(F.col("whole"), F.lit(2 ** 63 - 1)).alias("_upto"))
        if True in kinds:
            active = edges.join(ready.where("whole"), key, "left_semi").join(model, key)
            mine = points.select(*by, "seg_id", "x", "y", "z").join(active.select(*key, F.col("b").alias("seg_id")), [*by, "seg_id"])
            tests = active.select(*[F.col(c).alias(c) for c in (*key, "b", "ob", *KEEP, "mx", "my", "mz", "c", "s")])
            hit = mine.groupBy(*key).cogroup(tests.groupBy(*key)).applyInPandas(
                lambda p, e: _scan_seed(p, e, by, curve), schema)
            gone.append(session.cut_lineage(hit))
        if False in kinds:
            hit, model = _step(points, seg, edges, model, ready.where(~F.col("whole")), by, curve)
            gone.append(hit.select(*by, F.col("a").alias("into"), F.col("b").alias("seg_id")))
            reached = hit.select(*key, "upto")
            upto = upto.join(reached, key, "left").select(*key, F.coalesce("_upto", "upto", F.lit(2 ** 63 - 1)).alias("_upto"))
        taken += gone
        if len(taken) >= 20:
            taken = [session.cut_lineage(append_segments(*taken))]
        # Tested candidates are settled, absorbed segments neither seed nor stand for others.
        lost = append_segments(*gone).select(*by, F.col("seg_id").alias("b"))
        rest = edges.join(upto, key, "left").where(F.col("_upto").isNull() | (F.col("ob") > F.col("_upto")))
        rest = rest.join(lost, [*by, "b"], "left_anti").join(lost.withColumnRenamed("b", "a"), key, "left_anti")
        edges = session.cut_lineage(rest.select(*by, "a", "b", "oa", "ob"))
    if not taken:
        return points.sparkSession.createDataFrame([], schema)
    return append_segments(*taken)


def _step(points: DataFrame, seg: DataFrame, edges: DataFrame, model: DataFrame, ready: DataFrame, by: list[str],
          curve: float) -> tuple[DataFrame, DataFrame]:
    """The next segment of each seed of ``ready``, as ``a, b, upto``, and the model with its sums added."""
    key = [*by, "a"]
    active = edges.join(ready, key, "left_semi")
    curves = _curves(model).select(*key, "mx", "my", "mz", "c", "s", "um", "vm", "q2", "q1", "q0")
    tests = active.join(curves, key).withColumnRenamed("b", "seg_id")
    p = session.attach(points.select(*by, "seg_id", "x", "y", "z"), tests, [*by, "seg_id"])
    u = (F.col("x") - F.col("mx")) * F.col("c") + (F.col("y") - F.col("my")) * F.col("s") - F.col("um")
    miss = F.abs((F.col("q2") * u + F.col("q1")) * u + F.col("q0") + F.col("vm") - (F.col("z") - F.col("mz")))
    worst = p.groupBy(*key, F.col("seg_id").alias("b"), "ob").agg(F.max(miss).alias("worst"))
    hit = worst.where(F.col("worst") < curve).groupBy(*key).agg(F.min(F.struct("ob", "b")).alias("h"))
    hit = session.cut_lineage(hit.select(*key, F.col("h.b").alias("b"), F.col("h.ob").alias("upto")))
    # Add the sums of the segments taken to their seeds.
    parts = seg.select(*by, F.col("seg_id").alias("b"), F.col("mx").alias("_bx"), F.col("my").alias("_by"),
                       F.col("mz").alias("_bz"), "n", *[M.name(e) for e in M.SPATIAL])
    added = hit.join(parts, [*by, "b"]).join(model.select(*key, "mx", "my", "mz", "c", "s"), key)
    d = F.expr("(_bx - mx) * c + (_by - my) * s").alias("_d")
    added = added.select(*key, d, (F.col("_bz") - F.col("mz")).alias("_dz"), *_profile())
    added = added.select(*key, *[F.expr(e).alias(f"_{n}") for n, e in _shifted("_d", "_dz").items()])
    model = model.join(added, key, "left").withColumns(
        {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0.0)) for n in KEEP}).drop(*[f"_{n}" for n in KEEP])
    return hit, session.cut_lineage(model)


def _scan_graph(points: DataFrame, seg: DataFrame, by: list[str], line: float, curve: float, height: float, seed: int,
                scan_rows: int) -> list[DataFrame]:
    """Accepted pairs of clouds with few gates: small pieces of their graph in one task each, others in rounds."""
    edges = session.cut_lineage(merge_gate_join(seg, line, height, seed, by))

    def fitting(nodes: DataFrame, tests: DataFrame, piece: list[str]) -> DataFrame:
        """Pieces that one task can scan, and whether there are others."""
        load = nodes.join(seg.select(*by, "seg_id", "n"), [*by, "seg_id"]).groupBy(*piece).agg(F.sum("n").alias("_rows"))
        load = load.join(tests.groupBy(*piece).agg(F.count(F.lit(1)).alias("_tests")), piece)
        return load.select(*piece, ((F.col("_rows") <= scan_rows) & (F.col("_tests") <= scan_rows)).alias("_fits"))

    keys, found = [*by, "component"], []
    comp = session.cut_lineage(connected_components(edges, by, "a", "b").withColumnRenamed("node", "seg_id"))
    named = session.cut_lineage(edges.join(comp.withColumnRenamed("seg_id", "a"), [*by, "a"]))
    small, large = _pieces(session.cut_lineage(fitting(comp, named, keys)))
    if small is not None:
        own = comp.join(small, keys, "left_semi").join(seg.select(*by, "seg_id", *FRAME), [*by, "seg_id"])
        rows = session.attach(points.select(*by, "seg_id", "x", "y", "z"), own, [*by, "seg_id"])
        schema = T.StructType([f for f in edges.schema if f.name in by]
                              + [T.StructField("into", T.LongType()), T.StructField("seg_id", T.LongType())])
        # Each row gets its own name: both tables come from the same edges.
        tests = named.join(small, keys, "left_semi").select(*[F.col(c).alias(c) for c in (*by, "component", "a", "b", "oa", "ob")])
        found.append(rows.groupBy(*keys).cogroup(tests.groupBy(*keys)).applyInPandas(lambda p, e: _scan(p, e, by, curve), schema))
    if large is not None:
        many = named.join(large, keys, "left_semi").select(*by, "a", "b", "oa", "ob")
        found.append(_scan_rounds(points, seg, many, by, curve, scan_rows))
    return found


def _pieces(table: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of ``table`` that fit one task each, and the others; None where there are none."""
    kinds = {r["_fits"] for r in table.select("_fits").distinct().collect()}
    return tuple(table.where(c).drop("_fits") if k in kinds else None for k, c in ((True, F.col("_fits")), (False, ~F.col("_fits"))))


# --- passes -------------------------------------------------------------------------------------

def find_merges(segments: DataFrame, points: DataFrame, by: Sequence[str] = BY, line: float = 0.5, curve: float = 0.2,
                height: float = 4.0, seed: int = 10, azimuth: bool = False, scan_rows: int | None = None) -> DataFrame:
    """``by..., into, seg_id``: which segment each absorbed one goes to. ``segments`` has ``ord``."""
    by = list(by)
    scan_rows = SCAN_ROWS if scan_rows is None else scan_rows
    points = real_points(points, "x", "y", "z")
    seg = session.cut_lineage(segment_frames(points, by, azimuth=azimuth).join(segments.select(*by, "seg_id", "ord"), [*by, "seg_id"]))
    # A small cloud is scanned whole; only larger ones are cut, in runs of their order or into the pieces of their graph.
    load = session.cut_lineage(seg.groupBy(*by).agg((F.sum("n") <= scan_rows).alias("_fits")))
    clouds, wide = _pieces(load)
    crowded = _crowded(seg.join(wide, by, "left_semi"), by, line, height, seed) if wide is not None else None
    crowded = None if crowded is None or session.is_empty(crowded) else crowded
    found = []
    whole = [t.select(*by) for t in (clouds, crowded) if t is not None]
    if whole:
        own = append_segments(*whole)
        found.append(_scan_order(points, seg.join(own, by, "left_semi"), by, line, curve, height, seed, scan_rows))
    if crowded is not None:
        wide = wide.join(crowded, by, "left_anti")
    if wide is not None and not session.is_empty(wide):
        found += _scan_graph(points, seg.join(wide, by, "left_semi"), by, line, curve, height, seed, scan_rows)
    if not found:
        return seg.select(*by, F.col("seg_id").alias("into"), "seg_id").limit(0)
    return session.cut_lineage(append_segments(*found))


def merge_pass(segments: DataFrame, points: DataFrame, by: Sequence[str] = BY, order: str = "stale",
               **gates) -> tuple[DataFrame, DataFrame, bool]:
    """One pass over segments (with ``ord``) and their points: (segments, points, changed)."""
    by = list(by)
    segments = session.cut_lineage(segments)
    merged = find_merges(segments, points, by, **gates)
    changed = not session.is_empty(merged)
    gain = merged.join(segments.select(*by, "seg_id", "count"), [*by, "seg_id"]).groupBy(
        *by, F.col("into").alias("seg_id")).agg(F.sum("count").alias("_gain"))
    left = drop_absorbed(segments, by, merged).join(gain, [*by, "seg_id"], "left")
    left = session.cut_lineage(left.withColumn("count", F.col("count") + F.coalesce("_gain", F.lit(0).cast("long"))).drop("_gain"))
    after = session.cut_lineage(rerank_after_merge(segments, left, by, order))
    if changed:
        points = session.cut_lineage(absorb_points(points, merged, by))
    moved = after.join(segments.select(*by, "seg_id", F.col("ord").alias("_o")), [*by, "seg_id"]).where("ord <> _o")
    return after, points, changed or not session.is_empty(moved)


def merge_segments(segments: DataFrame, points: DataFrame, passes: int = 3, by: Sequence[str] = BY,
                   order: str = "stale", **gates) -> tuple[DataFrame, DataFrame]:
    """Up to ``passes`` merge passes; a pass that changes nothing would repeat itself, so it is the last."""
    segments = session.cut_lineage(rank_segments(segments, by))
    for _ in range(passes):
        segments, points, changed = merge_pass(segments, points, by, order, **gates)
        if not changed:
            break
    return segments, points


def max_abs_residual(pairs: DataFrame, points: DataFrame, seg: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``by..., a, b, worst``: largest height difference between b's points and a's parabola.

    ``seg`` are :func:`segment_frames`; ``pairs`` has ``a, b``.
    """
    by = list(by)
    model = seg.select(*by, F.col("seg_id").alias("a"), *_profile("mx", "my", "mz", "c", "s"))
    curves = _curves(model).drop("k1", "k2", "k3", "k4", "v0", "v1", "v2", "n", "sd", "sse")
    tests = pairs.select(*by, "a", "b").join(curves, [*by, "a"]).withColumnRenamed("b", "seg_id")
    p = session.attach(points.select(*by, "seg_id", "x", "y", "z"), tests, [*by, "seg_id"])
    u = (F.col("x") - F.col("mx")) * F.col("c") + (F.col("y") - F.col("my")) * F.col("s") - F.col("um")
    miss = F.abs((F.col("q2") * u + F.col("q1")) * u + F.col("q0") + F.col("vm") - (F.col("z") - F.col("mz")))
    return p.groupBy(*by, "a", F.col("seg_id").alias("b")).agg(F.max(miss).alias("worst"))


def pair_merge_test(pairs: DataFrame, points: DataFrame, by: Sequence[str] = BY, limit: float = 0.1,
                    start: Sequence[float] | None = OFFSET_START) -> DataFrame:
    """``by..., a, b, mean_off, mean_gap, merge`` by the catenary of a: 1 when both means are below ``limit``.

    A seed with fewer than three points never merges.
    """
    by, key = list(by), [*by, "a"]
    axis = principal_axis(points.withColumnRenamed("seg_id", "a"), key).select(*key, "n", "mean_x", "mean_y", "mean_z", "angle")
    axis = session.sized(axis.join(pairs.select(*key).distinct(), key, "left_semi"))
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    dx, dy = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    local = {"u": dx * c + dy * s, "w": dy * c - dx * s, "v": F.col("z") - F.col("mean_z")}
    mine = points.withColumnRenamed("seg_id", "a").join(axis.where("n >= 3"), key).select(*key, *[e.alias(n) for n, e in local.items()])
    fit = _offset_coef(mine, key, start)
    tests = pairs.select(*by, "a", "b").join(axis, key).join(fit, key, "left").withColumnRenamed("b", "seg_id")
    other = session.attach(points.select(*by, "seg_id", "x", "y", "z"), tests, [*by, "seg_id"])
    other = other.withColumns(local)
    out = other.groupBy(*by, "a", F.col("seg_id").alias("b")).agg(
        F.avg("w").alias("mean_off"), F.avg(catenary_offset(F.col("coef"), F.col("u")) - F.col("v")).alias("mean_gap"))
    ok = (F.abs("mean_off") < limit) & (F.abs("mean_gap") < limit)
    return out.withColumn("merge", F.coalesce(ok.cast("int"), F.lit(0)))


def _offset_coef(data: DataFrame, key: list[str], start: Sequence[float] | None) -> DataFrame:
    """Coefficients of each group's catenary; the keys are renamed meanwhile, as the fit has a column ``a`` too."""
    renamed = [f"_key{i}" for i in range(len(key))]
    fit = fit_catenary_offset(data.withColumnsRenamed(dict(zip(key, renamed))), renamed, "u", "v", start)
    return fit.select(*[F.col(r).alias(k) for r, k in zip(renamed, key)], F.array("a", "c", "b").alias("coef"))
