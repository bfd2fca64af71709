"""Whitening by an incremental eigendecomposition.

Every task walks over its vectors and keeps mean and spectrum of those seen so far. A vector changes the scatter
matrix by a rank-one term about the running mean; the new eigenvalues are the roots of the secular equation, after
eigenpairs that the term does not move have been set aside (deflation), and the new vectors follow from the roots.
Spectra of tasks are combined in a tree: one enters the other eigenpair by eigenpair, each as a rank-one term, and
the two means as one more. The result spans the space but carries the rounding of many updates, so one more pass
over the vectors projects the covariance on it (Rayleigh-Ritz) and takes the eigenpairs of that small matrix.

A task holds one d x d matrix, a rank-one update costs O(d^3), and whatever leaves a task has at most d x d numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagline.llm.shared import stored

# Tables of one row per task are combined by so many rows at a time.
FAN = 8
# Variances below this share of the trace are rounding; nothing can be scaled by them.
FLAT = 1e-13
_EPS = float(np.finfo(np.float64).eps)


def quantised(vector: str, steps: int) -> Column:
    """``floor(steps * c)`` of each entry as long; null if the vector is null or has a null or non-finite entry.

    Products beyond 64 bits end at the largest or smallest long.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(v, lambda c: F.floor(F.lit(float(steps)) * c) + F.lit(0).cast("long")))


# --- rank-one updates ----------------------------------------------------------------------------

def secular_roots(lam: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """``lam_j - mu_i`` (row i, column j) for the roots mu of 1 + rho * sum_j z2_j / (lam_j - mu) = 0.

    ``lam`` rises strictly, ``z2`` and ``rho`` are positive: one root follows each pole. Roots are sought as offsets from the
    nearer pole, by rational steps that match both sums of poles, halving where a step leaves the bracket.
    """
    m = len(lam)
    w = rho * z2
    i = np.arange(m)
    gap = np.append(np.diff(lam), w.sum())
    right = np.zeros(m, bool)
    if m > 1:
        mid = lam[:-1] + gap[:-1] / 2
        right[:-1] = 1 + (w / (lam - mid[:, None])).sum(1) < 0
    origin = i + right
    poles = lam - lam[origin][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(i == m - 1, gap, gap / 2))
    tau = (low + high) / 2
    last = np.minimum(i + 1, m - 1)
    todo = i
    for _ in range(100):
        at, lo, hi = tau[todo], low[todo], high[todo]
        d = poles[todo] - at[:, None]
        inverse = 1 / d
        # The poles up to a root's own give negative terms, the others positive ones.
        lower = inverse * (todo[:, None] >= i)
        minus = lower @ w
        plus = inverse @ w - minus
        f = 1 + minus + plus
        lo, hi = np.where(f < 0, at, lo), np.where(f < 0, hi, at)
        open_ = (np.abs(f) > (m + 4) * _EPS * (1 + plus - minus)) & (hi - lo > _EPS * np.abs(at))
        if not open_.any():
            break
        below = (lower * inverse) @ w
        above = (inverse * inverse) @ w - below
        row = np.arange(len(todo))
        dl, dr = d[row, todo], d[row, last[todo]]
        with np.errstate(all="ignore"):
            c = f - below * dl - above * dr
            b = c * (dl + dr) + below * dl * dl + above * dr * dr
            q = np.sqrt(np.maximum(b * b - 4 * c * f * dl * dr, 0))
            step = np.where(b <= 0, (b - q) / (2 * c), 2 * f * dl * dr / (b + q))
            step = np.where(todo == m - 1, dl + below * dl * dl / (f - below * dl), step)
        new = at + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        todo = todo[open_]
        tau[todo], low[todo], high[todo] = new[open_], lo[open_], hi[open_]
    return poles - tau[:, None]


def rank_one(lam: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs, values rising, of ``vectors diag(lam) vectors' + rho v v'`` for ``rho >= 0``; ``lam`` rises."""
    z = v @ vectors
    size = float(z @ z)
    if not rho * size > 0:
        return lam, vectors
    tol = 8 * _EPS * max(abs(lam[0]), abs(lam[-1]), rho * size)
    vectors = vectors.copy()
    # Equal values: a reflection within their space leaves one vector that the term touches.
    start = np.flatnonzero(np.append(True, np.diff(lam) > tol))
    end = np.append(start[1:], len(lam))
    for a, e in zip(start[end - start > 1], end[end - start > 1]):
        norm = np.sqrt(z[a:e] @ z[a:e])
        u = z[a:e].copy()
        u[-1] += np.copysign(norm, u[-1])
        if norm > 0:
            u /= np.sqrt(u @ u)
            vectors[:, a:e] -= 2 * np.outer(vectors[:, a:e] @ u, u)
            z[a:e - 1], z[e - 1] = 0, -np.copysign(norm, z[e - 1])
    touched = np.zeros(len(lam), bool)
    touched[end - 1] = rho * np.abs(z[end - 1]) * np.sqrt(size) > tol
    if not touched.any():
        return lam, vectors
    poles, part = lam[touched], z[touched]
    apart = secular_roots(poles, part * part, rho)
    # The term that has exactly these roots; its vectors are orthogonal to rounding.
    ratio = poles[:, None] - poles
    np.fill_diagonal(ratio, 1.0)
    exact = np.sqrt(np.abs((apart / ratio).prod(0)) / rho)
    turn = (np.copysign(exact, part) / apart).T
    turn /= np.sqrt((turn * turn).sum(0))
    lam = lam.copy()
    lam[touched] = poles - np.diagonal(apart)
    vectors[:, touched] = vectors[:, touched] @ turn
    order = np.argsort(lam, kind="stable")
    return lam[order], vectors[:, order]


class Spectrum:
    """Number, mean and scatter eigenpairs of vectors met one by one, or with another spectrum's all at once."""

    def __init__(self, dims: int):
        self.n, self.mean, self.lam, self.vectors = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.lam, self.vectors = rank_one(self.lam, self.vectors, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, n: int, mean: np.ndarray, lam: np.ndarray, vectors: np.ndarray) -> None:
        for value, vector in zip(lam, vectors.T):
            self.lam, self.vectors = rank_one(self.lam, self.vectors, vector, max(float(value), 0.0))
        off, both = mean - self.mean, self.n + n
        self.lam, self.vectors = rank_one(self.lam, self.vectors, off, self.n * n / both)
        self.mean, self.n = self.mean + off * (n / both), both

    def row(self, part: int) -> tuple:
        return part, self.n, self.mean.tobytes(), self.lam.tobytes(), self.vectors.tobytes()


SPECTRUM = "part long, n long, mean binary, lam binary, vectors binary"
MATRIX = "part long, sums binary"


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy().reshape(-1, dims)


def _spectrum(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dims)
        for rows in _matrices(batches, dims):
            for x in rows.astype(np.float64):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([own.row(TaskContext.get().partitionId())], columns=["part", "n", "mean", "lam", "vectors"]),
                                             preserve_index=False)
    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    own = Spectrum(len(rows["mean"].iloc[0]) // 8)
    for r in rows.itertuples():
        part = [np.frombuffer(b) for b in (r.mean, r.lam, r.vectors)]
        own.merge(r.n, part[0], part[1], part[2].reshape(len(part[0]), -1))
    return pd.DataFrame([own.row(int(rows["part"].iloc[0]) // FAN)], columns=rows.columns)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    sums = sum(np.frombuffer(b) for b in rows["sums"])
    return pd.DataFrame([(int(rows["part"].iloc[0]) // FAN, sums.tobytes())], columns=rows.columns)


def _tree(df: DataFrame, combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str):
    """The one row that is left of a table with a row per task, combined ``FAN`` neighbours at a time."""
    df = stored(df, "tree")
    while (df.agg(F.max("part")).first()[0] or 0) > 0:
        df = stored(df.groupBy(F.floor(F.col("part") / FAN).alias("_node")).applyInPandas(combine, schema), "tree")
    return df.first()


def _products(dims: int, mean: np.ndarray, basis: np.ndarray):
    """Sums of products of the centred vectors' coordinates in ``basis``, one matrix per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((basis.shape[1], basis.shape[1]))
        for rows in _matrices(batches, dims):
            y = (rows - mean) @ basis
            sums += y.T @ y
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": sums.tobytes()}])
    return run


# --- the operator --------------------------------------------------------------------------------

def _totals(dims: int):
    """Per component the sums of the upper and the lower 32 bits, which cannot overflow within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for rows in _matrices(batches, dims):
            n, high, low = n + len(rows), high + (rows >> 32).sum(0), low + (rows & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"dim": range(dims), "n": n, "high": high, "low": low}).astype("int64"), preserve_index=False)
    return run


def _squares(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over components of ``(n x - S)^2`` in whole numbers; null beyond 64 bits."""
    reach = max((max(abs(n * int(rows[:, j].max()) - s), abs(n * int(rows[:, j].min()) - s), abs(n * int(np.abs(rows[:, j]).max())), abs(s))
                 for j, s in enumerate(sums)), default=0)
    if reach * reach * max(len(sums), 1) < 1 << 63:
        return ((n * rows - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(r, sums)) for r in rows.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _result(dims: int, n: int, sums: list[int], mean: np.ndarray, scale: np.ndarray, explained: list[float], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).flatten().to_numpy().reshape(-1, dims)
            y = ((rows - mean) @ scale).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(1).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(y), n)), pa.array([d for d in _squares(rows, n, sums) for _ in range(k)], pa.int64()),
                pa.array(y, mask=np.isnan(y)), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(y), error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of integer vectors (see :func:`quantised`).

    The model is fitted on every distinct vector once: ``n`` of them, with sums S. ``deviation`` is the exact sum of
    ``(n x - S)^2``, null beyond 64 bits; ``whitened`` the coordinate of ``x - S / n`` on a unit eigenvector of their
    covariance over the root of its eigenvalue; ``explained`` that eigenvalue's share of the trace; ``identity_error``
    how far the whitened covariance, taken in a pass of its own, is from the identity. An eigenvector's largest entry
    is positive. Components without variance have a null ``whitened`` and count as explained 0; they are left out of the error.

    Rows whose vector is null take no part; those without key or with a repeated one do. Vectors with other numbers of
    components are fitted by themselves; vectors without components, and empty tables, give no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    schema = f"key {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = stored(vectors.where(F.size(vector) > 0).select(F.col(vector).alias("x"), F.col(key).alias("key")), "vectors")
    fit = stored(kept.select("x").distinct(), "fit-list")
    out = spark.createDataFrame([], schema)
    for (dims,) in sorted(fit.select(F.size("x")).distinct().collect()):
        own = fit.where(F.size("x") == dims)
        totals = own.mapInArrow(_totals(dims), "dim long, n long, high long, low long").groupBy("dim").agg(
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("dim").collect()
        n = int(totals[0]["n"])
        sums = [(int(r["high"]) << 32) + int(r["low"]) for r in totals]
        mean = np.array([s / n for s in sums])
        spectrum = _tree(own.mapInArrow(_spectrum(dims), SPECTRUM), _merged, SPECTRUM)
        basis = np.linalg.qr(np.frombuffer(spectrum["vectors"]).reshape(dims, dims))[0]
        ritz = np.frombuffer(_tree(own.mapInArrow(_products(dims, mean, basis), MATRIX), _added, MATRIX)["sums"]).reshape(dims, dims) / n
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        trace, values = float(np.trace(ritz)), values[::-1][:components]
        axes = (basis @ turn)[:, ::-1][:, :components]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        spread = values > FLAT * trace
        scale = np.where(spread, axes / np.sqrt(np.where(spread, values, 1.0)), np.nan)
        real = scale[:, spread]
        error = 0.0
        if spread.any():
            unit = np.frombuffer(_tree(own.mapInArrow(_products(dims, mean, real), MATRIX), _added, MATRIX)["sums"])
            error = float(np.abs(unit.reshape(real.shape[1], -1) / n - np.eye(real.shape[1])).max())
        explained = np.where(spread, values / (trace if trace > 0 else 1.0), 0.0).tolist()
        out = out.unionByName(kept.where(F.size("x") == dims).mapInArrow(_result(dims, n, sums, mean, scale, explained, error), schema))
    return out.withColumnRenamed("key", key)
