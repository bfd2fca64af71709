"""Mixing sources to target weights by the cube method.

A document of a source with expected copies r is taken floor(r) times, and once more with the fractional
probability. Those last copies are drawn together: the vector of probabilities is moved through the null
space of the balancing constraints (documents and tokens of the source), where every step fixes at least one
document at 0 or 1, until no more documents are open than there are constraints. Chunks of a source take
this flight in parallel; what they leave open flies again, until each source has a few documents to land.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagline.llm.shared import stored

CHUNK = 4096
WEIGHTS = (5, 2, 1)
CAP = 3.0
# Sources are entries of a mixing plan; more than this is refused, as they pass through the driver.
MAX_SOURCES = 100_000
_EPS = 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; excess goes to the others by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        whole = sum(weights[i] for i in sorted(open_))
        share = {i: left * weights[i] / whole for i in sorted(open_)}
        above = [i for i in sorted(open_) if share[i] > cap * sizes[i]]
        if not above:
            for i, s in share.items():
                out[i] = s
            break
        for i in above:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for equal design probabilities, balanced on count and size: at most two stay fractional.

    Three open documents at a time: the null vector of their constraints is the cross product of the rows
    (1, 1, 1) and (sizes); with two left only equal sizes have one. The step goes either way with the
    probabilities that keep every document's expectation.
    """
    p = p.astype(float).copy()
    draws = iter(rng.random(2 * len(p) + 8))
    waiting, at, active = len(p), 0, []
    while True:
        while len(active) < 3 and at < waiting:
            if _EPS < p[at] < 1 - _EPS:
                active.append(at)
            at += 1
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            v = (b - c, c - a, a - b)
            if v == (0, 0, 0):
                v = (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            v = (1.0, -1.0)
        else:
            return p
        up = min(((1 - p[i]) / w if w > 0 else p[i] / -w) for i, w in zip(active, v) if w)
        down = min((p[i] / w if w > 0 else (1 - p[i]) / -w) for i, w in zip(active, v) if w)
        step = up if next(draws) * (up + down) < down else -down
        for i, w in zip(active, v):
            p[i] += step * w
            if p[i] <= _EPS or p[i] >= 1 - _EPS:
                p[i] = round(p[i])
        active = [i for i in active if 0 < p[i] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the few documents still open, the subset nearest to the expected size, then count; then the first one."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        want, many = float((p * size)[open_].sum()), float(p[open_].sum())
        picks = [np.array([(m >> i) & 1 for i in range(len(open_))]) for m in range(1 << len(open_))]
        p[open_] = min(picks, key=lambda x: (abs((x * size[open_]).sum() - want), abs(x.sum() - many)))
    return p


def _flight(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "size", "row"], kind="stable")
        size = rows["size"].to_numpy(np.float64)
        p = fly(rows["p"].to_numpy(np.float64), size, np.random.default_rng([seed, level, int(key[0]), int(key[1])]))
        return rows.assign(p=land(p, size) if last else p)
    return run


def _levels(counts: list[int], chunk: int) -> list[list[int]]:
    """Numbers of chunks of each source at each level; every source ends in one."""
    out = []
    while True:
        chunks = [max(ceil(c / chunk), 1) for c in counts]
        out.append(chunks)
        if max(chunks, default=1) == 1:
            return out
        counts = [2 * c for c in chunks]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 17, chunk: int = CHUNK,
        key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` of every row of ``docs`` (and the row as ``doc`` with ``carry``).

    Sources in code point order, null last, weigh ``weights`` in turn and share the words of the whole table;
    a target stops at ``cap`` times its source's size. ``copies`` times ``size`` are the words taken, at most
    ``ceil(cap)`` times the size. The draw depends on the seed and the ids, so that reruns agree; rows of
    repeated or null ids are drawn one by one. Null and empty texts have size 0 and are drawn like any other. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    own = [F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] if carry else []
    base = stored(docs.select(*own, F.col(key).cast("long").alias("_id"), F.col(source).alias("_src"),
                              word_count(text).alias("_size"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    sums = base.groupBy("_src").agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [int(r["w"]) for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], cap)
    plan = [(i, r[0], w, g, int(r["n"]), int(g // w) if w else 0) for i, (r, w, g) in enumerate(zip(sums, sizes, goal))]
    levels = _levels([r["n"] for r in sums], chunk)
    table = spark.createDataFrame([(*x, x[3] / x[2] - x[5] if x[2] else 0.0) for x in plan],
                                  "_i int, _name string, source_size long, target double, _n long, _whole long, _part double")
    rows = base.join(F.broadcast(table), F.col("_src").eqNullSafe(F.col("_name")))
    state = rows.where((F.col("_part") > _EPS) & (F.col("_part") < 1 - _EPS)).select(
        F.col("_i").alias("i"), F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_row").alias("row"),
        F.xxhash64(F.lit(seed), F.col("_id"), F.col("_size"), F.when(F.col("_id").isNull(), F.col("_row"))).alias("h"), F.col("_part").alias("p"))
    drawn = []
    for level, chunks in enumerate(levels):
        last = level == len(levels) - 1
        parts = spark.createDataFrame(list(enumerate(chunks)) or [(0, 1)], "i int, parts int")
        dealt = state.join(F.broadcast(parts), "i").withColumn(
            "chunk", F.pmod(F.xxhash64(F.lit(level), F.col("h")), "parts").cast("int")).drop("parts")
        flown = dealt.groupBy("i", "chunk").applyInPandas(_flight(seed, level, last), dealt.schema).drop("chunk")
        if not last:
            flown = stored(flown, "mix-flight")
        drawn.append(flown.where("p >= 1").select(F.col("row").alias("_won")))
        state = flown.where("p > 0 AND p < 1")
    won = drawn[0]
    for d in drawn[1:]:
        won = won.unionByName(d)
    full = F.when(F.col("_part") >= 1 - _EPS, 1).otherwise(0)
    out = rows.join(won, F.col("_row") == F.col("_won"), "left").withColumn(
        "_copies", F.col("_whole") + full + F.when(F.col("_won").isNotNull(), 1).otherwise(0))
    return out.select(*["doc"] * carry, F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                      F.col("_copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is drawn, with the columns of ``docs``."""
    out = mix(docs, carry=True, **options)
    return out.where("copies > 0").select("doc", F.explode(F.expr("sequence(1L, copies)"))).select("doc.*")
