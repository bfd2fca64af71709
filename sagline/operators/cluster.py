"""Euclidean clusters: connected components of the "no farther than d" graph."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagline import session
from sagline.functions.geometry import real_points
from sagline.operators.grid import AXES, LEAF_PAIRS, link_join, linking_cells

BY = ("cloud_id",)
# Once a graph has shrunk to this many edges in total it is finished in one task per cloud.
LOCAL_EDGES = 200_000
# A node with more edges than this, and than its share of all edges that bounds the number of such nodes, is a hub.
HUB_EDGES = 10_000


def _finish(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Least label of each node of a bounded edge list, by repeated pointer jumping."""
    ids, flat = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    u, v = flat.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        nxt = root.copy()
        np.minimum.at(nxt, root[u], low)
        np.minimum.at(nxt, root[v], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(len(ids)))
    return out.assign(node=ids, component=ids[root])


def connected_components(edges: DataFrame, by: Sequence[str] = BY, a: str = "node_a", b: str = "node_b",
                         local_edges: int | None = None) -> DataFrame:
    """``by..., node, component`` for all nodes that have an edge; the component is its least node.

    Alternating large-star and small-star rounds, each of which keeps components intact and halves
    path lengths. A graph of no more than ``local_edges`` edges is finished directly. The edges of a
    hub never meet in one task: they stay where they are and learn the hub's least neighbour from a
    broadcast table, which has at most ``session.BROADCAST_ROWS`` rows as there are no more hubs.
    """
    by = list(by)
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    e = edges.select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = session.cut_lineage(e)
    state = None
    while True:
        size, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        if size <= local_edges:
            schema = T.StructType([f for f in e.schema if f.name in by]
                                  + [T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])
            return e.groupBy(*by).applyInPandas(lambda pdf: _finish(pdf, by), schema)
        if state == (size, mark):
            break
        state = (size, mark)
        e = session.cut_lineage(_small_star(_large_star(e, by, size), by, size))
    leaves = e.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def hub_degree(edges: int) -> int:
    """Degree above which a node of a graph is a hub; fewer than ``session.BROADCAST_ROWS`` nodes can exceed it."""
    return max(HUB_EDGES, 2 * edges // session.BROADCAST_ROWS)


def with_least(e: DataFrame, low: DataFrame, by: list[str], edges: int) -> DataFrame:
    """Add to the edges of ``e`` the value ``m`` of their node ``u``; ``low`` has ``by..., u, m, degree``."""
    on, limit = [*by, "u"], hub_degree(edges)
    hubs = low.where(F.col("degree") > limit).select(*on, F.col("m").alias("_hub"))
    marked = e.join(F.broadcast(hubs), on, "left")
    rest = marked.where("_hub IS NULL").drop("_hub").join(low.where(F.col("degree") <= limit).drop("degree"), on)
    return marked.where("_hub IS NOT NULL").withColumnRenamed("_hub", "m").unionByName(rest)


def _large_star(e: DataFrame, by: list[str], edges: int) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*by, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return with_least(both.where("v > u"), low, by, edges).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, by: list[str], edges: int) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them; a star round adds no edges."""
    low = e.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    moved = with_least(e, low, by, edges).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select(*by, "u", F.col("m").alias("v"))).distinct()


def euclidean_clusters(points: DataFrame, distance: float, by: Sequence[str] = BY, x: str = "x", y: str = "y",
                       z: str = "z", label: str = "cluster_id", leaf_pairs: int = LEAF_PAIRS,
                       local_edges: int | None = None) -> DataFrame:
    """Add ``cluster_id``, the least ``point_id`` reachable in steps of at most ``distance``.

    Points are reduced to cells before the graph is built; rows with NaN coordinates are dropped.
    """
    by = list(by)
    real = real_points(points, x, y, z)
    edges = link_join(real, distance, by, x, y, z, leaf_pairs)
    comps = connected_components(edges, by, local_edges=local_edges)
    keys = [f"k{a}" for a in AXES]
    own = [c for c in real.columns]
    keyed = real.withColumns({f"_{a}": F.col(c).cast("double") for a, c in zip(AXES, (x, y, z))})
    keyed = linking_cells(keyed, distance, prefix="_")
    nodes = keyed.groupBy(*by, *keys).agg(F.min("point_id").alias("node"))
    named = nodes.join(comps, [*by, "node"], "left").select(*by, *keys, F.coalesce("component", "node").alias(label))
    return session.attach(keyed, named, [*by, *keys]).select(*own, label)
