import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sagline import session
from sagline.operators import cluster, grid, shape


def frame(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


def cloud(seed=0, n=300, copies=0, hot=0, clouds=1):
    """Uniform points, optionally with exact copies and a hot spot."""
    rng = np.random.default_rng(seed)
    parts = []
    for c in range(clouds):
        xyz = rng.uniform(0, 4, (n, 3))
        if hot:
            xyz = np.concatenate([xyz, rng.normal(2, 0.15, (hot, 3))])
        if copies:
            xyz = np.concatenate([xyz, np.repeat(xyz[:1], copies, axis=0)])
        p = pd.DataFrame(xyz, columns=list("xyz"))
        p.insert(0, "cloud_id", f"c{c}")
        p.insert(1, "point_id", np.arange(len(p), dtype="int64"))
        parts.append(p)
    return pd.concat(parts, ignore_index=True)


def pairs(p, r):
    xyz = p[["x", "y", "z"]].to_numpy()
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    return d2 <= r * r


@pytest.mark.parametrize("cell_rows", [2000, 5])
def test_radius_join_is_brute_force(spark, cell_rows):
    p = cloud(1, copies=20, clouds=2)
    got = grid.radius_join(frame(spark, p), 0.5, cell_rows=cell_rows).toPandas()
    for c, g in p.groupby("cloud_id"):
        want = set(zip(*np.nonzero(pairs(g, 0.5))))
        mine = got[got.cloud_id == c]
        assert len(mine) == len(want) and set(zip(mine.q_id, mine.n_id)) == want


@pytest.mark.parametrize("leaf_pairs", [4096, 16])
def test_full_cells_give_the_same_covariance(spark, leaf_pairs):
    p = cloud(2, n=200, copies=40, hot=400, clouds=2)
    p[["x", "y"]] += 292600.0
    df = frame(spark, p)
    plain = shape.local_covariance(df, 0.6).toPandas().set_index(["cloud_id", "point_id"]).sort_index()
    dense = shape.local_covariance(df, 0.6, cell_rows=3, leaf_pairs=leaf_pairs).toPandas().set_index(["cloud_id", "point_id"]).sort_index()
    assert (plain.n == dense.n).all()
    assert np.allclose(plain.to_numpy(), dense.to_numpy(), atol=1e-9, equal_nan=True)
    g = p[p.cloud_id == "c1"]
    near = pairs(g, 0.6)
    xyz = g[["x", "y", "z"]].to_numpy()
    for i in (0, 50, 300, 600):
        want = np.cov(xyz[near[i]].T) if near[i].sum() > 2 else None
        row = dense.loc[("c1", i)]
        assert row.n == near[i].sum()
        if want is not None:
            assert np.allclose([row.cxx, row.cxy, row.cxz, row.cyy, row.cyz, row.czz],
                               [want[0, 0], want[0, 1], want[0, 2], want[1, 1], want[1, 2], want[2, 2]], atol=1e-9)


def test_axis_is_the_largest_eigenvector(spark):
    p = cloud(3, n=400)
    got = shape.local_shape(frame(spark, p), 0.7).toPandas().set_index("point_id")
    near, xyz = pairs(p, 0.7), p[["x", "y", "z"]].to_numpy()
    seen = 0
    for i in range(len(p)):
        if near[i].sum() < 3:
            assert np.isnan(got.linearity[i])
            continue
        w, v = np.linalg.eigh(np.cov(xyz[near[i]].T))
        assert np.allclose([got.l1[i], got.l2[i], got.l3[i]], w[::-1], atol=1e-10)
        if (w[2] - w[1]) / w[2] > 0.05:
            assert abs(np.dot(v[:, 2], [got.ex[i], got.ey[i], got.ez[i]])) > 1 - 1e-9
            seen += 1
    assert seen > 50


def test_constant_neighbourhood_has_no_axis(spark):
    p = pd.DataFrame({"cloud_id": "c", "point_id": range(5), "x": 1.0, "y": 1.0, "z": 1.0})
    row = shape.local_shape(frame(spark, p), 0.5).first()
    assert row.n == 5 and row.ex is None and row.linearity is None


def test_nan_points_are_in_no_neighbourhood(spark):
    p = cloud(4, n=30)
    p.loc[3, "z"] = np.nan
    got = shape.local_shape(frame(spark, p), 3.0).toPandas()
    assert 3 not in set(got.point_id) and got.n.max() <= 29


def union_find(p, d):
    near = pairs(p, d)
    label = np.arange(len(p))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(p))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("leaf_pairs,local_edges", [(4096, None), (4, None), (4096, 0)])
def test_clusters_are_connected_components(spark, leaf_pairs, local_edges):
    p = cloud(5, n=250, copies=15, hot=200, clouds=2)
    got = cluster.euclidean_clusters(frame(spark, p), 0.35, leaf_pairs=leaf_pairs, local_edges=local_edges).toPandas()
    assert len(got) == len(p)
    for c, g in p.groupby("cloud_id"):
        mine = got[got.cloud_id == c].sort_values("point_id").cluster_id.to_numpy()
        assert (mine == union_find(g, 0.35)).all()


@pytest.mark.parametrize("local_edges", [None, 0])
def test_long_chain_is_one_cluster(spark, local_edges):
    n = 1500
    order = np.random.default_rng(6).permutation(n)
    p = pd.DataFrame({"cloud_id": "c", "point_id": order, "x": np.arange(n) * 0.29, "y": 0.0, "z": 10.0})
    p = pd.concat([p, pd.DataFrame({"cloud_id": ["c"], "point_id": [n], "x": [n * 0.29 + 0.1], "y": [0.0], "z": [10.0]})])
    got = cluster.euclidean_clusters(frame(spark, p), 0.3, local_edges=local_edges).toPandas()
    assert got[got.point_id < n].cluster_id.unique().tolist() == [0]
    assert got[got.point_id == n].cluster_id.tolist() == [n]


def test_link_boundary_is_inclusive(spark):
    p = pd.DataFrame({"cloud_id": "c", "point_id": [0, 1, 2], "x": [0.0, 0.5, 1.0 + 1e-9], "y": 0.0, "z": 0.0})
    got = cluster.euclidean_clusters(frame(spark, p), 0.5).toPandas().sort_values("point_id")
    assert got.cluster_id.tolist() == [0, 0, 2]


@pytest.mark.parametrize("metric", ["3d", "vertical"])
def test_nearest_is_brute_force(spark, metric):
    t, q = cloud(7, n=500, clouds=2), cloud(8, n=25, clouds=3)
    q[["x", "y", "z"]] = (q[["x", "y", "z"]] - 1.5) * 40
    t.loc[10, ["x", "y", "z"]] = t.loc[5, ["x", "y", "z"]]
    got = grid.nearest_join(frame(spark, q.rename(columns={"point_id": "q_id"})), frame(spark, t), side=0.3, levels=4,
                            metric=metric).toPandas().set_index(["cloud_id", "q_id"])
    assert len(got) == 50
    cols = ["x", "y", "z"] if metric == "3d" else ["x", "y"]
    for (c, i), row in got.iterrows():
        here = t[t.cloud_id == c]
        at = q[(q.cloud_id == c) & (q.point_id == i)].iloc[0]
        d = ((here[cols] - at[cols].astype(float)) ** 2).sum(axis=1).to_numpy()
        k = int(np.argmin(d))
        assert row.n_id == here.point_id.iloc[k]
        assert np.isclose(row.dist, np.sqrt(d[k]) if metric == "3d" else at.z - here.z.iloc[k])


@pytest.mark.parametrize("block_pairs", [1_000_000, 50])
def test_blocks_give_every_neighbour(spark, monkeypatch, block_pairs):
    """Several blocks, negative coordinates, points and neighbours exactly on block borders and at the radius."""
    monkeypatch.setattr(grid, "BLOCK_PAIRS", block_pairs)
    p = cloud(7, n=500, copies=5, clouds=2)
    p[["x", "y", "z"]] = np.concatenate([p[["x", "y", "z"]].to_numpy()[:-60] - 2, np.random.default_rng(1).integers(-8, 9, (60, 3)) * 0.25])
    p.loc[3, "x"] = np.nan
    got = grid.neighbour_sums(frame(spark, p), 0.25).toPandas().set_index(["cloud_id", "point_id"]).sort_index()
    p = p.dropna()
    assert len(got) == len(p)
    for c, g in p.groupby("cloud_id"):
        xyz = g[["x", "y", "z"]].to_numpy()
        d = xyz[None] - xyz[:, None]
        near = (d[..., 0] ** 2 + d[..., 1] ** 2) + d[..., 2] ** 2 <= 0.25 * 0.25
        want = {"n": near.sum(1), "sy": (near * d[..., 1]).sum(1), "sxz": (near * d[..., 0] * d[..., 2]).sum(1), "szz": (near * d[..., 2] ** 2).sum(1)}
        mine = got.loc[c].loc[g.point_id]
        for name, values in want.items():
            assert np.allclose(mine[name], values, atol=1e-12)


def test_a_point_is_sent_about_twice_by_one_exchange(spark):
    p = cloud(8, n=4000)
    df = frame(spark, p)
    sent = grid.in_blocks(df.select("cloud_id", "point_id", "x", "y", "z"), ["cloud_id"], 0.1)
    assert sent.where("_own").count() == len(p) and sent.count() < 2.1 * len(p)
    plan = shape.local_covariance(df, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("hub", [20, 10_000])
def test_hubs_do_not_gather(spark, monkeypatch, hub):
    """Components with hubs of both kinds: far larger and far smaller than their neighbours."""
    monkeypatch.setattr(cluster, "HUB_EDGES", hub)
    rng = np.random.default_rng(12)
    pairs_ = [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(1000, 1300)] + [(i, i + 1) for i in range(2000, 2060)]
    pairs_ += [(5000, 5001), (7000, 7001), (7001, 7000), (8000, 8000)]
    rng.shuffle(pairs_)
    edges = spark.createDataFrame([(c, int(a), int(b)) for c in ("p", "q") for a, b in pairs_], "cloud_id string, node_a long, node_b long")
    got = cluster.connected_components(edges, local_edges=0).toPandas()
    want = {**{i: 0 for i in range(300)}, **{i: 1000 for i in [*range(1000, 1300), 5000, 5001]}, **{i: 2000 for i in range(2000, 2061)}, 7000: 7000, 7001: 7000}
    for c in ("p", "q"):
        mine = got[got.cloud_id == c]
        assert dict(zip(mine.node, mine.component)) == want and len(mine) == len(want)


def test_a_star_is_spread_over_the_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 200_000
        star = spark.range(1, n + 1, numPartitions=8).select(F.lit("c").alias("cloud_id"), F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        low = star.groupBy("cloud_id", "u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
        met = cluster.with_least(star, low, ["cloud_id"], n)
        rows = [r[1] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == n and max(rows) <= 2 * sorted(rows)[len(rows) // 2]
        assert met.where("m <> 0").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # No more hubs than may be broadcast, however many edges there are.
    for edges in (1, 10 ** 6, 10 ** 13):
        assert 2 * edges / (cluster.hub_degree(edges) + 1) < session.BROADCAST_ROWS


def test_top_of_the_pyramid(spark):
    """A 2 km cube in cells of a centimetre: at most eight boxes per cloud at the top, and the queries are not exchanged for it."""
    rng = np.random.default_rng(8)
    t = pd.DataFrame(rng.uniform(-1000, 1000, (3000, 3)), columns=list("xyz"))
    t.insert(0, "cloud_id", np.where(np.arange(3000) % 3 == 0, "a", "b"))
    t.insert(1, "point_id", np.arange(3000, dtype="int64"))
    t.loc[t.cloud_id == "b", ["x", "y"]] += 292600.0
    boxes = spark.createDataFrame(t).selectExpr("cloud_id", *[f"cast(floor({a} / 0.01) as long) as k{a}" for a in "xyz"],
                                                *[f"{a} as lo{a}" for a in "xyz"], *[f"{a} as hi{a}" for a in "xyz"])
    grids = grid.pyramid(boxes, ["cloud_id"], "xyz")
    assert len(grids) == 7
    assert all(r["count"] <= 8 for r in grids[-1].groupBy("cloud_id").count().collect())
    q = pd.DataFrame(rng.uniform(-1200, 1200, (60, 3)), columns=list("xyz"))
    q.insert(0, "cloud_id", "a")
    q.insert(1, "q_id", np.arange(60, dtype="int64"))
    found = grid.nearest_join(spark.createDataFrame(q), spark.createDataFrame(t), side=0.01)
    a = t[t.cloud_id == "a"]
    d2 = ((q[list("xyz")].to_numpy()[:, None] - a[list("xyz")].to_numpy()[None]) ** 2).sum(-1)
    got = found.toPandas().set_index("q_id").sort_index()
    assert (got.n_id.to_numpy() == a.point_id.to_numpy()[d2.argmin(1)]).all()
    assert np.allclose(got.dist, np.sqrt(d2.min(1)))
    # One cell, and no targets at all.
    one = grid.nearest_join(spark.createDataFrame(q), spark.createDataFrame(a.head(1)), side=1e6).toPandas()
    assert set(one.n_id) == {int(a.point_id.iloc[0])} and len(one) == 60
    assert grid.nearest_join(spark.createDataFrame(q), spark.createDataFrame(a).limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["3d", "vertical"])
def test_nearest_cuts_full_cells(spark, monkeypatch, metric):
    """Many points in one cell, 300 of them copies: no query meets more than a few places at once."""
    rng = np.random.default_rng(4)
    t = pd.DataFrame(rng.uniform(0, 1, (3000, 3)), columns=list("xyz")).assign(cloud_id="c", point_id=range(3000))
    t.loc[:299, ["x", "y", "z"]] = 0.25
    q = pd.DataFrame(rng.uniform(-0.2, 1.2, (40, 3)), columns=list("xyz")).assign(cloud_id="c", q_id=range(40))
    held, plain = [], grid._leaf_rows
    monkeypatch.setattr(grid, "_leaf_rows", lambda *a: held.append(plain(*a)) or held[-1])
    got = grid.nearest_join(spark.createDataFrame(q), spark.createDataFrame(t), side=2.0, metric=metric).toPandas().set_index("q_id").sort_index()
    cols = list("xyz") if metric == "3d" else list("xy")
    d2 = ((q[cols].to_numpy()[:, None] - t[cols].to_numpy()[None]) ** 2).sum(-1)
    assert (got.n_id.to_numpy() == t.point_id.to_numpy()[d2.argmin(1)]).all()
    assert len(held) == 2 and all(h.selectExpr("max(size(_rows))").first()[0] <= grid.LEAF_ROWS for h in held)


def test_cells_of_medium_fill_need_no_halving(spark, monkeypatch):
    """Cells above ``cell_rows`` gave ever larger joins of halved cells; now each meets its neighbours as a block of its own."""
    p = cloud(12, n=300, copies=40, hot=500, clouds=2)
    p[["x", "y"]] += 292600.0
    df = frame(spark, p)
    plain = grid.neighbour_sums(df, 0.6).toPandas().set_index(["cloud_id", "point_id"]).sort_index()
    halved = []
    monkeypatch.setattr(grid, "_dense_sums", lambda *a: halved.append(a))
    got = grid.neighbour_sums(df, 0.6, cell_rows=100).toPandas().set_index(["cloud_id", "point_id"]).sort_index()
    assert not halved and (got.n == plain.n).all()
    assert np.allclose(got.to_numpy(), plain.to_numpy(), atol=1e-9)
    for c, g in p.groupby("cloud_id"):
        assert (got.loc[c].n.to_numpy() == pairs(g, 0.6).sum(1)).all()


@pytest.mark.parametrize("hot", [0, 700])
def test_radius_join_compares_few_pairs_beyond_the_radius(spark, hot):
    """Full cells met all of the 27 around them, of which 16% are near; now they are halved and far ones are left out."""
    p = cloud(13, n=300, copies=10, hot=hot)
    p[["x", "y"]] += 292600.0
    df = frame(spark, p).withColumns({a: F.round(a, 3) for a in "xyz"})
    p[["x", "y", "z"]] = df.orderBy("point_id").select("x", "y", "z").toPandas()
    got = grid.radius_join(df, 0.3).toPandas()
    want = set(zip(*np.nonzero(pairs(p, 0.3))))
    assert len(got) == len(want) and set(zip(got.q_id, got.n_id)) == want
    q = df.select("cloud_id", F.col("point_id").alias("q_id"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    cells = grid._adjacent(q, ["cloud_id"], 0.3, 0.15, 2)
    own = df.select("cloud_id", *[grid.cell(a, 0.15).alias(f"k{a}") for a in "xyz"])
    assert cells.count() <= 125 * len(p) * 0.75
    if hot:
        assert len(want) / cells.join(own, ["cloud_id", "kx", "ky", "kz"]).count() > 0.24


def test_quick_rounding_is_rounding(spark):
    from checks.queries import quick_r, r
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(0, 0.01, 20000), rng.integers(0, 20000, 20000) / 2e6, rng.integers(1, 999, 200) * 1e7 + 0.1234565, [0.0, np.inf, np.nan]])
    rows = spark.createDataFrame(pd.DataFrame({"v": v}))
    assert rows.where(~quick_r("v").eqNullSafe(r("v"))).count() == 0
    many = rows.selectExpr("v", "explode(sequence(1, 20)) i").selectExpr("v * i AS v")
    assert many.where(~quick_r("v").eqNullSafe(r("v"))).count() == 0
