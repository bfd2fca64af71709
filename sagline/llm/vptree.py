"""Nearest neighbours by cosine with vantage-point trees, one per shard of the vectors.

On unit vectors the Euclidean distance orders like the cosine, so the triangle inequality holds. Equal vectors
are indexed once with their smallest ids. Every shard's tree is stored as one row of arrays; queries travel in
blocks to every shard, which answers with its nearest; the answers are merged per query. A subtree is skipped
if the distance to its shell exceeds ``factor`` times the distance of the worst neighbour so far: 1 is exact,
less than 1 searches less.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, frexp, ldexp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagline.llm.shared import stored

SHARD_VECTORS = 8192
LEAF = 128
QUERY_BLOCK = 256
_SLACK = 1e-9


class Tree:
    """A vantage-point tree over rows of ``unit``, as arrays that can be stored.

    ``order`` is a permutation of the rows. A node covers a range of it: a leaf's rows, or a vantage point at the
    range's start, then the rows within ``radius`` of it, then the others. ``node`` rows are start, inner end, end.
    """

    def __init__(self, unit: np.ndarray, order: np.ndarray, node: np.ndarray, radius: np.ndarray):
        self.unit, self.order, self.node, self.radius = unit, order, node, radius
        self.child = {(int(a), int(c)): i for i, (a, _, c) in enumerate(node)}

    @classmethod
    def build(cls, unit: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, radii = np.arange(len(unit)), [], []
        todo = [(0, len(unit))]
        rng = np.random.default_rng(len(unit))
        while todo:
            a, c = todo.pop()
            if c - a <= leaf:
                nodes.append((a, a, c))
                radii.append(-1.0)
                continue
            pick = a + int(rng.integers(c - a))
            order[[a, pick]] = order[[pick, a]]
            d = np.sqrt(((unit[order[a + 1:c]] - unit[order[a]]) ** 2).sum(1))
            by = np.argsort(d, kind="stable")
            order[a + 1:c] = order[a + 1:c][by]
            half = (c - a - 1) // 2
            nodes.append((a, a + 1 + half, c))
            radii.append(float(d[by[half - 1]]))
            todo += [(a + 1, a + 1 + half), (a + 1 + half, c)]
        return cls(unit, order, np.array(nodes, np.int64).reshape(-1, 3), np.array(radii))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> list[np.ndarray]:
        """Rows that may be among the ``k`` nearest of each unit query; all ties with the last are kept."""
        best = np.full((len(queries), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def meet(which: np.ndarray, own: np.ndarray) -> np.ndarray:
            """Distances of some queries to some rows; those that may count are kept."""
            d = np.sqrt(np.maximum(2 - 2 * (queries[which] @ self.unit[own].T), 0))
            near = d <= best[which, -1:] + _SLACK
            if near.any():
                q, r = np.nonzero(near)
                found.append((which[q], own[r], d[q, r]))
                closer = near.any(1)
                merged = np.concatenate([best[which[closer]], d[closer]], 1)
                merged.partition(k - 1, 1)
                best[which[closer]] = np.sort(merged[:, :k], 1)
            return d

        def visit(a: int, c: int, which: np.ndarray) -> None:
            if a >= c or not len(which):
                return
            i = self.child[a, c]
            _, m, _ = self.node[i]
            if self.radius[i] < 0:
                meet(which, self.order[a:c])
                return
            d, r = meet(which, self.order[a:a + 1])[:, 0], self.radius[i]
            inner = d <= r
            visit(a + 1, m, which[inner])
            visit(m, c, which[~inner])
            reach = factor * best[which, -1] + _SLACK
            visit(m, c, which[inner & (r - d <= reach)])
            visit(a + 1, m, which[~inner & (d - r <= reach)])

        visit(0, len(self.order), np.arange(len(queries)))
        if not found:
            return [np.zeros(0, np.int64)] * len(queries)
        q, r, d = (np.concatenate(x) for x in zip(*found))
        last = d <= best[q, -1] + _SLACK
        q, r = q[last], r[last]
        by = np.argsort(q, kind="stable")
        return np.split(r[by], np.searchsorted(q[by], np.arange(1, len(queries))))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(1, keepdims=True))


def _scaled(v: list[float]) -> list[float]:
    """``v`` times the power of two that brings its largest component to 0.5 or more, below 1: sums neither overflow nor vanish."""
    shift = frexp(max(map(abs, v)))[1]
    return [ldexp(x, -shift) for x in v]


def cosine(a: list[float], b: list[float]) -> float:
    """Cosine in double precision, sums from first to last component; scaling by powers of two changes no digit of it."""
    ab = aa = bb = 0.0
    for x, y in zip(_scaled(a), _scaled(b)):
        ab += x * y
        aa += x * x
        bb += y * y
    return ab / (aa ** 0.5 * bb ** 0.5)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(rows["v"].to_list(), np.float64)
    tree = Tree.build(_unit(vectors))
    return pd.DataFrame([(int(rows["shard"].iloc[0]), vectors.shape[1], vectors.tobytes(), [list(x) for x in rows["ids"]],
                          tree.order.tobytes(), tree.node.tobytes(), tree.radius.tobytes())],
                        columns=["shard", "dims", "vectors", "ids", "permutation", "node", "radius"])


INDEX = "shard int, dims int, vectors binary, ids array<array<long>>, permutation binary, node binary, radius binary"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part: not null, not zero, no null or non-finite component, some id."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def build_index(rows: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """One row per shard: its tree over the distinct vectors dealt to it, each with its ``k + 1`` smallest ids.

    More copies can never be among the nearest ``k`` of any query, as ties go to smaller ids.
    """
    # Ids of one vector meet in two steps, so that a very common vector is cut down before its rows come together.
    part = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = part.groupBy("v", "_salt").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    distinct = stored(few.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")),
                      "vectors")
    shards = max(ceil(distinct.count() / shard_vectors), 1)
    dealt = distinct.withColumn("dims", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard", "dims").applyInPandas(_index, INDEX), "vector-trees")


def _answers(k: int, factor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                vectors = np.frombuffer(r.vectors).reshape(-1, r.dims)
                tree = Tree(_unit(vectors), np.frombuffer(r.permutation, np.int64), np.frombuffer(r.node, np.int64).reshape(-1, 3),
                            np.frombuffer(r.radius))
                queries = np.array([list(q) for q in r.queries], np.float64)
                out = []
                for q, own, found in zip(r.query_ids, queries.tolist(), tree.search(_unit(queries), k + 1, factor)):
                    near = []
                    for i in found:
                        score = cosine(own, vectors[i].tolist())
                        near += [(-score, int(x)) for x in r.ids[i] if x != q]
                    out += [(int(q), i, -s) for s, i in sorted(near)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding",
            shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row whose id is divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id;
    candidates have the query's number of components. Equal scores rank by the smaller id. A repeated id counts
    as one candidate per distinct vector and asks once per distinct vector. An empty table gives no rows.
    """
    rows = usable(vectors, key, vector)
    index = build_index(rows, k, shard_vectors)
    asked = rows.where(F.col("id") % every == 0).distinct().withColumn("dims", F.size("v"))
    many = max(ceil(asked.count() / query_block), 1)
    blocks = asked.groupBy("dims", F.pmod(F.xxhash64("id"), F.lit(many)).alias("part")).agg(
        F.collect_list(F.struct("id", "v")).alias("q")).select(
        "dims", "part", F.col("q.id").alias("query_ids"), F.col("q.v").alias("queries"))
    # The stated query set, in blocks, meets every shard of the same number of components.
    met = index.join(blocks, "dims").repartition(many * 4, "shard", "part")
    found = met.mapInPandas(_answers(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
