import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sagline.operators import generate, ordering


def rows(spark, n=900):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"cloud_id": np.where(np.arange(n) < n // 3, "hot", rng.choice(list("abc"), n)),
                      "point_id": rng.permutation(n), "t": np.round(rng.uniform(0, 5, n), 1),
                      "x": rng.uniform(0, 9, n), "y": rng.uniform(0, 9, n), "z": rng.uniform(0, 9, n)})
    p.loc[: n // 4, "t"] = 2.0
    return p, spark.createDataFrame(p).repartition(6)


def test_range_split_numbers_like_one_window(spark):
    p, df = rows(spark)
    for order in (["t", "point_id"], ["-t", "point_id"]):
        small = ordering.number_rows(df, ["cloud_id"], order).toPandas().set_index("point_id").rn.sort_index()
        large = ordering.number_rows(df, ["cloud_id"], order, limit=10).toPandas().set_index("point_id").rn.sort_index()
        assert small.equals(large)
    want = p.sort_values(["t", "point_id"]).groupby("cloud_id").cumcount() + 1
    got = ordering.number_rows(df, ["cloud_id"], ["t", "point_id"], limit=10).toPandas().set_index("point_id").rn
    assert (got.sort_index().to_numpy() == want.set_axis(p.point_id[want.index]).sort_index().to_numpy()).all()


def test_range_split_finds_the_next_row(spark):
    _, df = rows(spark)
    a, b = (ordering.next_row(df, ["cloud_id"], ["point_id"], ["x", "z"], limit=k)
            .select("point_id", "next.x", "next.z").toPandas().set_index("point_id").sort_index() for k in (None, 10))
    assert a.equals(b)
    assert a.x.isna().sum() == 4


def test_sample_keeps_every_kth(spark):
    p, df = rows(spark)
    got = ordering.systematic_sample(df, 10, limit=20).toPandas()
    for c, g in p.groupby("cloud_id"):
        assert sorted(got[got.cloud_id == c].point_id) == sorted(g.point_id)[::10]


def test_split_parts_share_border_rows(spark):
    df = spark.createDataFrame([("w", i) for i in range(1, 11)], "cloud_id string, rank long")
    got = generate.split_by_position(df, ["cloud_id"]).toPandas()
    assert got[got.c1]["rank"].tolist() == [1, 2, 3, 4, 5]
    assert got[got.c2]["rank"].tolist() == [6, 7, 8, 9, 10]
    assert got[got.c3]["rank"].tolist() == [5, 6]


def test_gap_filling_reaches_every_gap(spark):
    df = spark.createDataFrame([("w", 0, 0.0, 0.0, 5.0), ("w", 1, 1.0, 0.0, 5.0), ("w", 2, 3.5, 0.0, 5.0), ("w", 3, 3.6, 0.0, 5.0)],
                               "wire_id string, point_id long, x double, y double, z double")
    fits = spark.createDataFrame([("w", [1.0, 0.0, 2.0])], "wire_id string, p array<double>")
    got = generate.fill_gaps(df, fits, 0.5, ["wire_id"])
    new = got.where("inserted").orderBy("x").toPandas()
    want = np.concatenate([np.linspace(0, 1, 4)[1:-1], np.linspace(1, 3.5, 7)[1:-1]])
    assert np.allclose(new.x, want) and np.allclose(new.z, want ** 2 + 2) and (new.y == 0).all()
    assert got.where(~F.col("inserted")).count() == 4
