import numpy as np
import pandas as pd
import pytest
from corridor import corridor
from pyspark.sql import functions as F

from sagline.operators import classes, ground, segments
from sagline.plans import class_summary, extract_power_lines, wire_summary


@pytest.fixture(scope="module")
def clouds():
    """The same corridor near the origin and 300 km away; ids repeat between clouds."""
    return pd.concat([corridor(), corridor(offset=(3e5, 3e5), cloud="far")], ignore_index=True)


@pytest.fixture(scope="module")
def found(spark, clouds):
    return extract_power_lines(spark.createDataFrame(clouds.drop(columns="true_wire")).repartition(8))


def test_wires_are_found_whole(clouds, found):
    wires = found.wires.toPandas()
    points = found.points.toPandas().merge(clouds[["cloud_id", "point_id", "true_wire"]], on=["cloud_id", "point_id"])
    for cloud, here in clouds.groupby("cloud_id"):
        mine = wires[wires.cloud_id == cloud]
        assert sorted(mine.wire_id) == [0, 1, 2, 3]
        assert np.allclose(sorted(mine.length), [25, 28, 30, 30], atol=0.2)
        p = points[points.cloud_id == cloud]
        assert (p.groupby("wire_id").true_wire.nunique() == 1).all() and p.true_wire.nunique() == 4
        assert len(p) > 0.97 * here.true_wire.notna().sum()
    assert np.allclose(found.lengths.toPandas().total_length, 113, atol=0.5)
    assert found.fits.count() == 8


def test_translation_and_neighbour_clouds_change_nothing(found):
    p = found.points.select("cloud_id", "wire_id", "point_id").toPandas()
    sets = [set(map(tuple, g[["wire_id", "point_id"]].to_numpy())) for _, g in p.groupby("cloud_id")]
    assert len(sets[0] ^ sets[1]) <= 0.01 * len(sets[0])


def test_densified_points_are_a_separate_output(found):
    d = found.densified.groupBy("cloud_id", "wire_id").count().toPandas()
    lengths = found.wires.toPandas().set_index(["cloud_id", "wire_id"]).length
    for row in d.itertuples():
        assert row.count == int(lengths[(row.cloud_id, row.wire_id)] // 0.1)
    assert found.points.where(F.col("cloud_id") == "c0").count() == found.wires.where("cloud_id = 'c0'").agg(F.sum("count")).first()[0]


def test_summary_has_clearance_and_report(spark, found):
    c0 = F.col("cloud_id") == "c0"
    s = wire_summary(found.points.where(c0), found.fits.where(c0 & (F.col("wire_id") < 3)), found.ground.where(c0)).toPandas()
    s = s.sort_values("wire_id")
    assert (s.method == "catenary").all()
    assert np.allclose(sorted(s.distance), [10, 10.5, 12, 14], atol=0.1)
    assert s.report.iloc[0].startswith("=== Wire 1 ===\np = [") and "Ground clearance (lowest point):" in s.report.iloc[0]
    assert s.report.iloc[3].startswith("No poly info available for this wire.\nGround clearance")
    low = s.low.iloc[0]
    assert np.isclose(s.distance.iloc[0] ** 2, sum((low[a] - s.ground.iloc[0][a]) ** 2 for a in "xyz"))


def test_class_summary(spark, clouds):
    s = class_summary(spark.createDataFrame(clouds.drop(columns="true_wire")))
    got = {(r.cloud_id, r.value): (r["name"], r.n) for r in s.classes.collect()}
    assert got["c0", 8][0] == "Low voltage wire"
    assert got["c0", 2] == ("Ground", 9000) and len(got) == 10
    b = s.bounds.where("cloud_id = 'far'").first()
    assert b.xmin < b.cx < b.xmax and b.cx > 2.9e5


def one_cloud(spark, heights):
    return spark.createDataFrame([("c", i, 0.0, 0.0, float(h), 0) for i, h in enumerate(heights)],
                                 "cloud_id string, point_id long, x double, y double, z double, classification int")


def test_bin_edges_belong_below(spark):
    hist = ground.z_histogram(one_cloud(spark, range(0, 51))).toPandas().set_index("bin").n
    assert hist[1] == 2 and (hist.drop(1) == 1).all() and len(hist) == 50


def test_threshold_errors(spark):
    with pytest.raises(ValueError, match="modal height bin"):
        ground.split_ground(one_cloud(spark, [0, *[100] * 9]))
    with pytest.raises(ValueError, match="equal"):
        ground.split_ground(one_cloud(spark, [7] * 5))
    with pytest.raises(ValueError, match="no points"):
        extract_power_lines(one_cloud(spark, []))


def test_nan_heights_are_in_neither_part(spark):
    above, below = ground.split_ground(one_cloud(spark, [0] * 20 + [1, 50, 100, float("nan")]))
    assert below.count() == 21 and above.count() == 2


def test_no_line_points_give_empty_results(spark):
    out = extract_power_lines(one_cloud(spark, [0] * 20 + [1, 50, 100]))
    assert out.wires.count() == out.fits.count() == out.densified.count() == 0


def test_class_filter_and_names(spark):
    df = one_cloud(spark, [1, 2, 3]).withColumn("classification", F.lit(42))
    assert df.select(classes.class_name(F.col("classification")).alias("n")).first().n == "Class 42"
    assert df.select(classes.class_name(F.col("classification"), {42: "Mast"}).alias("n")).first().n == "Mast"
    assert classes.filter_class(df, [1, 2]).count() == 0


def test_size_and_length_edges(spark):
    rows = [("c", s, i, 0.0, 0.0, 0.0) for s, n in ((0, 14), (1, 15)) for i in range(n)]
    df = spark.createDataFrame(rows, "cloud_id string, cluster_id long, point_id long, x double, y double, z double")
    assert segments.min_cluster_size(df).select("cluster_id").distinct().collect()[0].cluster_id == 1
    rows = [("c", s, i, i * n / 10, 0.0, 5.0) for s, n in ((0, 1.49), (1, 1.51)) for i in range(11)]
    df = spark.createDataFrame(rows, "cloud_id string, seg_id long, point_id long, x double, y double, z double")
    assert segments.min_length(df).select("seg_id").distinct().collect()[0].seg_id == 1
