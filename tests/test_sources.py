import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagline.plans import wire_summary
from sagline.sources.las import ingest_las, read_las
from sagline.sources.npz import read_ground, read_wires
from sagline.sources.points import read_points
from sagline.sources.wires import read_wire_info, write_ground, write_wire_arrays, write_wire_info, write_wires


def las_bytes(xyz, codes, form, version=(1, 2), scale=0.001, offset=(500.0, -20.0, 3.0)):
    """A minimal LAS file written by hand."""
    length = {0: 20, 1: 28, 3: 34, 6: 30}[form]
    size = 375 if version >= (1, 4) else 227
    head = bytearray(size)
    head[:4] = b"LASF"
    head[24], head[25] = version
    struct.pack_into("<H", head, 94, size)
    struct.pack_into("<I", head, 96, size + 10)
    head[104] = form
    struct.pack_into("<H", head, 105, length)
    struct.pack_into("<I", head, 107, 0 if version >= (1, 4) else len(xyz))
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, *offset)
    if version >= (1, 4):
        struct.pack_into("<Q", head, 247, len(xyz))
    body = b""
    for p, c in zip(xyz, codes):
        rec = bytearray(length)
        struct.pack_into("<3i", rec, 0, *[round((v - o) / scale) for v, o in zip(p, offset)])
        rec[15 if form < 6 else 16] = c
        body += bytes(rec)
    return bytes(head) + b"\0" * 10 + body


@pytest.mark.parametrize("form,version", [(0, (1, 2)), (3, (1, 3)), (6, (1, 4))])
def test_las_split_read(spark, tmp_path, form, version):
    rng = np.random.default_rng(form)
    xyz = np.round(rng.uniform(-50, 900, (3000, 3)), 3)
    codes = rng.integers(0, 20, 3000)
    (tmp_path / "one.las").write_bytes(las_bytes(xyz, codes, form, version))
    df = read_las(spark, str(tmp_path), split_bytes=7000)
    assert df.rdd.getNumPartitions() > 5
    got = df.toPandas().sort_values("point_id")
    assert got.point_id.tolist() == list(range(3000))
    assert np.allclose(got[["x", "y", "z"]], xyz, atol=1e-6)
    assert got.classification.tolist() == codes.tolist()
    assert set(got.cloud_id) == {"one.las"}


def test_las_class_bits_and_ingest(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_bytes([(1, 2, 3)], [0x20 | 5], 1))
    (tmp_path / "b.las").write_bytes(las_bytes([(4, 5, 6), (7, 8, 9)], [1, 2], 1))
    out = ingest_las(spark, str(tmp_path), str(tmp_path / "points")).toPandas()
    assert out[out.cloud_id == "a.las"].classification.tolist() == [5]
    assert len(out) == 3


def test_las_rejects_compressed(spark, tmp_path):
    raw = bytearray(las_bytes([(1, 2, 3)], [1], 1))
    raw[104] |= 0x80
    (tmp_path / "z.las").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="compressed"):
        read_las(spark, str(tmp_path)).collect()


def test_points_table_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 1.5, 2.5)], "point_id long, x double, y double, z double")
    rows.write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="cloud_id"):
        read_points(spark, str(tmp_path / "p"))
    got = read_points(spark, str(tmp_path / "p"), cloud_id=F.lit("flight")).first()
    assert got.classification == 0 and got.cloud_id == "flight"
    rows.withColumn("cloud_id", F.lit("c")).withColumn("classification", F.lit(None).cast("int")).write.option("header", True).csv(str(tmp_path / "c"))
    got = read_points(spark, str(tmp_path / "c"), "csv").first()
    assert (got.cloud_id, got.x, got.classification) == ("c", 0.5, 0)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_wire_archive_order(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    arrays = {f"wire_{i}": rng.normal(size=(50 + i, 3)) for i in (10, 9, 2, 1)}
    arrays["wire_2"] = np.asfortranarray(arrays["wire_2"])
    save(tmp_path / "w.npz", **arrays)
    points, wires = read_wires(spark, str(tmp_path / "w.npz"), "c")
    w = wires.orderBy("wire_id").toPandas()
    assert w.key.tolist() == ["wire_1", "wire_2", "wire_9", "wire_10"]
    assert w["count"].tolist() == [51, 52, 59, 60] and w.label.tolist() == [0, 1, 2, 3]
    got = points.where("wire_id = 1").orderBy("point_id").toPandas()
    assert np.array_equal(got[["x", "y", "z"]].to_numpy(), arrays["wire_2"])


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archive_split_by_rows(spark, tmp_path, save):
    from sagline.sources.npz import read_arrays
    a = np.random.default_rng(2).normal(size=(5000, 3))
    save(tmp_path / "g.npz", wire_0=a, wire_1=np.asfortranarray(a[::-1]))
    df = read_arrays(spark, str(tmp_path / "g.npz"), split_bytes=9000)
    assert df.rdd.getNumPartitions() > 10
    got = df.orderBy("key", "point_id").toPandas()
    assert np.array_equal(got[["x", "y", "z"]].to_numpy(), np.concatenate([a, a[::-1]]))


def test_ground_key_first_array_or_none(spark, tmp_path):
    np.savez(tmp_path / "named.npz", other=np.zeros((2, 3)), ground_points=np.ones((4, 3)))
    np.savez(tmp_path / "first.npz", b=np.ones((3, 3)), a=np.zeros((2, 3)))
    assert read_ground(spark, str(tmp_path / "named.npz")).count() == 4
    assert read_ground(spark, str(tmp_path / "first.npz")).count() == 3
    assert read_ground(spark, str(tmp_path / "absent.npz")) is None


def test_wire_info_both_forms(spark, tmp_path):
    records = [{"p": [1.0, 2.0, 3.0], "normr": 0.5, "df": 7.0, "rsq": 0.9, "mu_mean": 10.0, "mu_std": 2.0},
               {"p": [4.0, 5.0, 6.0], "normr": 0.25, "df": 8.0, "mu": [11.0, 3.0]}]
    (tmp_path / "info.json").write_text(json.dumps(records, indent=2))
    got = read_wire_info(spark, str(tmp_path / "info.json")).orderBy("wire_id").collect()
    assert [r.wire_id for r in got] == [0, 1]
    assert (got[0].mu_mean, got[1].mu_mean, got[1].mu_std, got[1].rsq) == (10.0, 11.0, 3.0, None)
    write_wire_info(read_wire_info(spark, str(tmp_path / "info.json")), str(tmp_path / "lines"))
    again = read_wire_info(spark, str(tmp_path / "lines"), "lines").orderBy("wire_id").collect()
    assert again == got


def test_parquet_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1, 1.0, 2.0, 3.0), ("b", 1, 1, 4.0, 5.0, 6.0)],
                                 "cloud_id string, wire_id int, point_id long, x double, y double, z double")
    write_wires(rows, str(tmp_path / "w"))
    write_ground(rows, str(tmp_path / "g"))
    assert sorted(p.name for p in (tmp_path / "w").glob("cloud_id=*")) == ["cloud_id=a", "cloud_id=b"]
    assert read_ground(spark, str(tmp_path / "g"), "parquet").where("cloud_id = 'b'").first().x == 4.0


def test_same_names_in_two_folders_are_two_clouds(spark, tmp_path):
    for folder, x in (("a", 1), ("b", 2)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "flight.las").write_bytes(las_bytes([(x, 0, 0), (x, 1, 1), (x, 2, 2)], [1, 1, 1], 1))
    got = read_las(spark, str(tmp_path / "in")).toPandas()
    assert set(got.cloud_id) == {"a/flight.las", "b/flight.las"} and len(set(zip(got.cloud_id, got.point_id))) == 6
    out = ingest_las(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    (tmp_path / "in" / "a" / "flight.las").write_bytes(las_bytes([(9, 0, 0)], [1], 1))
    (tmp_path / "in" / "b" / "flight.las").unlink()
    out = ingest_las(spark, str(tmp_path / "in"), str(tmp_path / "out")).toPandas()
    assert out.groupby("cloud_id").size().to_dict() == {"a/flight.las": 1, "b/flight.las": 3}


def test_fits_of_two_clouds_come_back(spark, tmp_path):
    rows = [(c, i, [1.0 * i, 2.0, 3.0], 0.5, 7.0, 0.9, 10.0, 2.0) for c in ("007", "b c") for i in range(3)]
    fits = spark.createDataFrame(rows, "cloud_id string, wire_id int, p array<double>, normr double, df double, rsq double, mu_mean double, mu_std double")
    write_wire_arrays(fits, str(tmp_path / "arrays"))
    assert sorted(map(tuple, read_wire_info(spark, str(tmp_path / "arrays")).collect())) == sorted(rows)
    write_wire_info(fits, str(tmp_path / "lines"))
    assert sorted(map(tuple, read_wire_info(spark, str(tmp_path / "lines"), "lines").collect())) == sorted(rows)
    with pytest.raises(Exception, match="gaps"):
        write_wire_arrays(fits.where("wire_id <> 1"), str(tmp_path / "bad"))
    (tmp_path / "broken.json").write_text("[{")
    with pytest.raises(Exception):
        read_wire_info(spark, str(tmp_path / "broken.json")).collect()


def test_summary_needs_the_cloud_of_a_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(c, 0, i, float(i), 0.0, 5 + 0.01 * (i - 20) ** 2 + float(rng.normal(0, 0.01))) for c in ("a", "b") for i in range(40)]
    points = spark.createDataFrame(rows, "cloud_id string, wire_id int, point_id long, x double, y double, z double")
    fits = spark.createDataFrame([(c, 0, [k, 0.0, 0.0], 0.5, 7.0, 0.9, 10.0, 2.0) for c, k in (("a", 1.0), ("b", 2.0))],
                                 "cloud_id string, wire_id int, p array<double>, normr double, df double, rsq double, mu_mean double, mu_std double")
    with pytest.raises(ValueError, match="cloud_id"):
        wire_summary(points, fits.drop("cloud_id"), None)
    got = wire_summary(points, fits, None).collect()
    assert len(got) == 2 and {r.cloud_id: r.p[0] for r in got} == {"a": 1.0, "b": 2.0} and all(r.converged for r in got)
