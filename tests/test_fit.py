import numpy as np
import pandas as pd
import pytest
from golden import WIRES
from pyspark.sql import functions as F

from sagline.functions.text import fixed
from sagline.operators import catenary, fit, generate, report, shape
from sagline.operators import segments as seg_ops

WIRE = ("cloud_id", "wire_id")


def golden_points():
    """Points rebuilt from each saved fit, with residuals of the saved norm orthogonal to the fit."""
    parts = []
    for i, (p0, p1, p2, normr, df, _, mean, std) in enumerate(WIRES):
        n = int(df) + 3
        rng = np.random.default_rng(i)
        u = np.linspace(-1, 1, n)
        u = (u - u.mean()) / u.std(ddof=1)
        basis = np.column_stack([u * u, u, np.ones(n)])
        e = rng.normal(size=n)
        e -= basis @ np.linalg.lstsq(basis, e, rcond=None)[0]
        e *= normr / np.linalg.norm(e)
        parts.append(pd.DataFrame({"cloud_id": "c", "wire_id": i, "point_id": np.arange(n), "x": mean + std * u,
                                   "y": 50.0 + i, "z": basis @ [p0, p1, p2] + e}))
    return pd.concat(parts, ignore_index=True)


def test_golden_fits_come_back(spark):
    points = golden_points()
    spread = points.groupby("wire_id").z.apply(lambda z: ((z - z.mean()) ** 2).sum())
    df = spark.createDataFrame(points).repartition(8)
    got = fit.polyfit2(df, WIRE).orderBy("wire_id").collect()
    for row, (p0, p1, p2, normr, dof, _, mean, std) in zip(got, WIRES):
        assert np.allclose(row.p, [p0, p1, p2], atol=1e-7)
        assert row.df == dof and row.n == dof + 3
        assert np.isclose(row.normr, normr, rtol=1e-6)
        assert np.isclose(row.rsq, 1 - normr ** 2 / spread[row.wire_id], atol=1e-9) and row.rsq > 0.98
        assert np.isclose(row.mu_mean, mean, atol=1e-6) and np.isclose(row.mu_std, std, rtol=1e-9)


def some_wires(shift=0.0, n=400):
    rng = np.random.default_rng(11)
    parts = []
    for i, az in enumerate((0.2, 1.2, 2.6, np.pi / 2)):
        t = rng.uniform(0, 30, n)
        parts.append(pd.DataFrame({
            "cloud_id": "c", "seg_id": i, "point_id": np.arange(n), "x": shift + t * np.cos(az) + rng.normal(0, .01, n),
            "y": shift + t * np.sin(az) + rng.normal(0, .01, n), "z": 12 + 0.01 * (t - 12) ** 2 + rng.normal(0, .01, n)}))
    return pd.concat(parts, ignore_index=True)


def frame_of(g):
    """Mean, turn and turned coordinates of a segment by numpy."""
    xyz = g[["x", "y", "z"]].to_numpy()
    c = xyz - xyz.mean(axis=0)
    w, v = np.linalg.eigh(np.cov(c.T))
    e = v[:, 2] if v[1, 2] >= 0 else -v[:, 2]
    a = np.arccos(np.clip(e[0], -1, 1))
    return xyz.mean(axis=0), a, c[:, 0] * np.cos(a) + c[:, 1] * np.sin(a), c[:, 2]


@pytest.mark.parametrize("shift", [0.0, 3e5])
def test_axis_length_and_rmse(spark, shift):
    p = some_wires(shift)
    df = spark.createDataFrame(p)
    axis = shape.principal_axis(df, ["cloud_id", "seg_id"]).toPandas().set_index("seg_id")
    length = seg_ops.segment_length(df).toPandas().set_index("seg_id")
    rmse = fit.fit_rmse(df).toPandas().set_index("seg_id")
    along = fit.polyfit2(df, axis="along").toPandas().set_index("seg_id")
    for i, g in p.groupby("seg_id"):
        _, a, u, v = frame_of(g)
        assert np.isclose(axis.angle[i], np.degrees(a), atol=1e-5)
        assert np.isclose(length.length[i], u.max() - u.min(), atol=1e-6)
        q = np.polyfit(u, v, 2)
        assert np.isclose(rmse.rmse[i], np.sqrt(np.mean((np.polyval(q, u) - v) ** 2)), atol=1e-7)
        assert np.isclose(along.normr[i], np.linalg.norm(np.polyval(q, u) - v), atol=1e-6)


def test_angle_is_of_the_axis_in_space(spark):
    t = np.linspace(0, 10, 50)
    df = spark.createDataFrame(pd.DataFrame({"seg_id": 0, "x": t, "y": t, "z": t}))
    tilted = shape.principal_axis(df, ["seg_id"]).first()
    flat = shape.principal_axis(df, ["seg_id"], azimuth=True).first()
    assert np.isclose(tilted.angle, np.degrees(np.arccos(1 / np.sqrt(3)))) and np.isclose(flat.angle, 45.0)


def test_few_distinct_abscissae_have_no_fit(spark):
    df = spark.createDataFrame([("c", 0, 1.0, 1.0), ("c", 0, 1.0, 2.0), ("c", 0, 2.0, 2.0), ("c", 1, 5.0, 1.0), ("c", 2, 1.0, 3.0),
                                ("c", 2, 2.0, 3.0), ("c", 2, 4.0, 3.0)], "cloud_id string, seg_id int, x double, z double")
    got = {r.seg_id: r for r in fit.polyfit2(df).collect()}
    assert got[0].p is None and got[1].p is None
    assert np.allclose(got[2].p, [0, 0, 3]) and got[2].rsq is None


def test_line_fit_needs_spread_in_x(spark):
    df = spark.createDataFrame([("c", 0, 1.0, 1.0), ("c", 0, 1.0, 2.0), ("c", 1, 3e5, 1.0), ("c", 1, 3e5 + 2, 2.0)],
                               "cloud_id string, seg_id int, x double, y double")
    got = {r.seg_id: r for r in fit.linefit_xy(df).collect()}
    assert got[0].slope is None and np.isclose(got[1].slope, 0.5)


def test_densified_points_are_the_curve(spark):
    p = some_wires()
    tiny = pd.DataFrame({"cloud_id": "c", "seg_id": [90, 90, 91, 91, 91], "point_id": range(5), "x": [0, 1, 0, .01, .02],
                         "y": [0, 1, 0, 0, .01], "z": [5.0, 5, 5, 5.001, 5]})
    got = generate.densify_wire(spark.createDataFrame(pd.concat([p, tiny])), 0.1, ("cloud_id", "seg_id")).toPandas()
    for i, g in p.groupby("seg_id"):
        mean, a, u, v = frame_of(g)
        k = int((u.max() - u.min()) // 0.1)
        at = np.linspace(u.max(), u.min(), k)
        want = np.column_stack([at * np.cos(a), at * np.sin(a), np.polyval(np.polyfit(u, v, 2), at)]) + mean
        mine = got[got.seg_id == i].sort_values("sample")
        assert len(mine) == k and np.allclose(mine[["x", "y", "z"]], want, atol=1e-6)
    raw = got[got.seg_id >= 90]
    assert len(raw) == 5 and raw["sample"].isna().all()


def catenaries():
    rng = np.random.default_rng(1)
    truth = [(40, 200, 0.3, 0.0), (60, 1500, 1.4, 292600.0), (100, 50, 2.5, 1000.0)]
    parts = []
    for i, (length, a, az, off) in enumerate(truth):
        t = rng.uniform(0, length, 2000)
        parts.append(pd.DataFrame({"cloud_id": "c", "wire_id": i, "point_id": np.arange(2000), "x": off + t * np.cos(az),
                                   "y": off + t * np.sin(az), "z": a * np.cosh((t - 0.4 * length) / a) - a + 20 + rng.normal(0, .005, 2000)}))
    return truth, pd.concat(parts, ignore_index=True)


def test_catenary_finds_the_parameters(spark):
    truth, p = catenaries()
    roof = pd.DataFrame({"cloud_id": "c", "wire_id": 3, "point_id": range(200), "x": np.linspace(0, 10, 200), "y": 1.0,
                         "z": 10 - (np.linspace(0, 10, 200) - 5) ** 2})
    short = pd.DataFrame({"cloud_id": "c", "wire_id": 4, "point_id": range(3), "x": [0.0, 1, 2], "y": 1.0, "z": 1.0})
    df = spark.createDataFrame(pd.concat([p, roof, short])).repartition(8)
    got = catenary.fit_catenary(df, WIRE).toPandas().set_index("wire_id")
    assert sorted(got.index) == [0, 1, 2, 3]
    for i, (length, a, az, _) in enumerate(truth):
        row = got.loc[i]
        assert row.method == "catenary" and np.isclose(row.a, a, rtol=0.02)
        assert row.sse < 1.1 * 2000 * 0.005 ** 2 and row.ux >= 0
    assert got.loc[3].method == "catenary" and got.converged.all()
    strict = catenary.fit_catenary(df, WIRE, accept=1.05)
    curves = generate.wire_curves(df, strict, 300, WIRE).toPandas()
    assert (curves.groupby("wire_id").size() == 300).all() and len(curves) == 1200
    line = curves[curves.wire_id == 3].sort_values("sample")
    assert np.allclose(line.z, np.interp(line.x, roof.x, roof.z), atol=1e-9)
    low = report.lowest_point(generate.sample_curve(got_df(spark, got), 300, WIRE), WIRE).toPandas().set_index("wire_id")
    assert np.allclose(low.z[[0, 1, 2]], 20, atol=0.02)


def test_straight_and_hogging_wires_converge(spark):
    t = np.linspace(0, 40, 300)
    shapes = {0: np.full(300, 7.0), 1: 5 + 0.1 * t, 2: 10 - 0.01 * (t - 20) ** 2}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"cloud_id": "c", "wire_id": i, "point_id": range(300), "x": t, "y": 1.0, "z": z})
                                          for i, z in shapes.items()]))
    got = catenary.fit_catenary(df, WIRE).toPandas().set_index("wire_id")
    assert got.converged.all() and (got.method == "catenary").all() and got.a.notna().all()
    # The bounds keep the lowest point near the wire, so a sloped line is met only about.
    assert got.sse[0] < 1e-2 and got.sse[1] < 300 * 0.15 ** 2
    cut = catenary.fit_catenary(df, WIRE, max_rounds=1).toPandas()
    assert not cut.converged.all()


def got_df(spark, got):
    return spark.createDataFrame(got.reset_index())


def test_offset_catenary_from_given_and_own_start(spark):
    u = np.linspace(-20, 35, 500)
    p = pd.concat([pd.DataFrame({"cloud_id": "c", "seg_id": i, "x": u, "z": -c + 3 + c * np.cosh((u - b) / c)})
                   for i, (c, b) in enumerate([(780.0, 0.0), (90.0, 12.0), (-300.0, 4.0)])])
    for start in (catenary.OFFSET_START, None):
        got = catenary.fit_catenary_offset(spark.createDataFrame(p), ("cloud_id", "seg_id"), start=start).toPandas().set_index("seg_id").sort_index()
        assert np.allclose(got.c, [780, 90, -300], rtol=1e-5) and np.allclose(got.b, [0, 12, 4], atol=1e-4)


def test_gap_prediction_follows_the_curve(spark):
    t = np.arange(0, 60, 0.02)
    df = spark.createDataFrame(pd.DataFrame({"cloud_id": "c", "wire_id": 0, "point_id": range(len(t)), "x": t, "y": 5.0,
                                             "z": 150 * np.cosh((t - 28) / 150)}))
    got = generate.predict_gap(df, WIRE).orderBy("sample").toPandas()
    gap = 40 - 30
    assert gap - 1 <= len(got) <= gap
    x = got.x + t.mean()
    assert np.allclose(got.z + (150 * np.cosh((t - 28) / 150))[::10].mean(), 150 * np.cosh((x - 28) / 150), atol=0.01)


def test_report_text(spark):
    rows = [(0, [1.0, 2.0, 3.5], 0.5, 7.0, 0.99, 10.0, 2.0, 4.25), (1, None, None, None, None, None, None, None),
            (2, [1.0], 0.5, 7.0, 0.0, 0.0, 2.0, None)]
    df = spark.createDataFrame(rows, "wire_id int, p array<double>, normr double, df double, rsq double, mu_mean double, mu_std double, d double")
    text = [r.report for r in report.wire_report(df, clearance="d").orderBy("wire_id").collect()]
    assert text[0] == ("=== Wire 1 ===\np = [1.000000  2.000000  3.500000]\nS.normr = 0.500000 | S.df = 7 | S.rsquared = 0.9900\n"
                       "mu = [mean=10.000000, std=2.000000]\n\nGround clearance (lowest point): 4.250 m")
    assert text[1] == "No poly info available for this wire."
    assert text[2] == "=== Wire 3 ===\np = [N/A]\nS.normr = 0.500000 | S.df = 7\n"


def test_ladders_halve_the_reads(spark, monkeypatch):
    """Reads of the points until all wires of a mixed set are done, and the curves they end in."""
    reads = []
    plain = catenary._tried
    monkeypatch.setattr(catenary, "_tried", lambda *a: reads.append(1) or plain(*a))
    rng = np.random.default_rng(6)
    rows = []
    for w, (a, b, n) in enumerate([(300.0, 20.0, 200), (80.0, 30.0, 150), (900.0, -10.0, 300), (45.0, 25.0, 90)]):
        t = np.sort(rng.uniform(0, 60, n))
        t[0], t[-1] = 0, 60
        rows.append(pd.DataFrame({"cloud_id": "c", "wire_id": w, "point_id": range(n), "x": t, "y": 0.0, "z": a * np.cosh((t - b) / a) + 5}))
    got = catenary.fit_catenary(spark.createDataFrame(pd.concat(rows))).toPandas().set_index("wire_id")
    assert got.converged.all() and np.allclose(got.a[[0, 1, 2, 3]], [300, 80, 900, 45], rtol=1e-6) and np.allclose(got.b[[0, 1, 2, 3]], [20, 30, -10, 25], atol=1e-4)
    assert len(reads) <= 8


def test_a_search_broadcasts_no_more_rows_than_allowed(spark, monkeypatch):
    """A wire has a row for each rung of the ladder; only the wires were counted."""
    sent, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or plain(df))
    monkeypatch.setattr("sagline.session.BROADCAST_ROWS", 10)
    t = np.tile(np.linspace(0, 60, 80), 4)
    w = np.repeat(np.arange(4), 80)
    z = np.array([300.0, 80.0, 900.0, 45.0])[w]
    points = pd.DataFrame({"cloud_id": "c", "wire_id": w, "point_id": range(320), "x": t, "y": 0.0, "z": z * np.cosh((t - 25) / z) + 5})
    got = catenary.fit_catenary(spark.createDataFrame(points)).toPandas().set_index("wire_id")
    assert got.converged.all() and np.allclose(got.a[[0, 1, 2, 3]], [300, 80, 900, 45], rtol=1e-6)
    assert sent and max(sent) <= 10


@pytest.mark.parametrize("axis,degree", [("x", 2), ("along", 2), ("x", 1)])
def test_residuals_of_very_good_fits(spark, axis, degree):
    """Noise of 1e-7 m on a curve of metres at projected coordinates, beside an ordinary group and one without noise."""
    rng = np.random.default_rng(21)
    parts = []
    for i, noise in enumerate((1e-7, 0.1, 0.0)):
        u = rng.uniform(-150, 150, 4000)
        z = 300.0 + 0.02 * u + (1e-3 * u * u if degree == 2 else 0.0)
        parts.append(pd.DataFrame({"cloud_id": "c", "wire_id": i, "mx": "a clashing name", "x": 292600.0 + u * 0.8, "y": 3500000.0 + u * 0.6,
                                   "z": z + noise * rng.normal(size=4000)}))
    points = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(points).repartition(4)
    got = fit.polyfit2(df, WIRE, axis=axis, degree=degree).toPandas().set_index("wire_id").sort_index()
    if axis == "along":
        rmse = fit.fit_rmse(df, WIRE, "x", "y", "z").toPandas().set_index("wire_id").sort_index()
    for i in (0, 1):
        own = points[points.wire_id == i]
        g = shape_frame(own) if axis == "along" else own.x.to_numpy() - 292600.0
        zc = own.z.to_numpy() - 300.0
        g = (g - g.mean()) / g.std()
        basis = np.vander(g, degree + 1)
        want = np.linalg.norm(zc - basis @ np.linalg.lstsq(basis, zc, rcond=None)[0])
        assert np.isclose(got.normr[i], want, rtol=1e-3)
        if axis == "along":
            assert np.isclose(rmse.rmse[i], want / np.sqrt(len(own)), rtol=1e-3)
    assert got.normr[2] < 1e-10 * np.sqrt(4000) * 100 and (got.df == 4000 - degree - 1).all()


def shape_frame(own):
    """Coordinates along the axis: its angle is that between the spatial axis and X."""
    xyz = own[["x", "y", "z"]].to_numpy()
    xyz = xyz - xyz.mean(0)
    ex = np.linalg.eigh(np.cov(xyz.T))[1][:, -1]
    ex = ex if ex[1] >= 0 else -ex
    a = np.arccos(ex[0])
    return xyz[:, 0] * np.cos(a) + xyz[:, 1] * np.sin(a)


@pytest.mark.parametrize("digits", [0, 3, 4, 6])
def test_numbers_as_text(spark, digits):
    rng = np.random.default_rng(30 + digits)
    values = [*(rng.normal(size=25_000) * 10.0 ** rng.integers(-8, 9, 25_000)), 0.0, -0.0, -1e-9, 1e-300, 5e-324, 0.9999996, 999.9999999, -0.9995,
              2.0 ** 53 + 2, 1e18, float("inf"), float("-inf"), float("nan")]
    # Every tie with up to nine binary places, its neighbours, and decimal halves that are no ties.
    ties = [(2 * k + 1) / 2.0 ** b for b in range(1, 10) for k in range(-300, 300)]
    values += ties + list(np.nextafter(ties, np.inf)) + list(np.nextafter(ties, -np.inf)) + [k / 10 ** digits + 0.5 / 10 ** digits for k in range(3000)]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values}))
    got = df.select("i", F.expr(fixed("v", digits)).alias("t")).toPandas().set_index("i").t
    wrong = [(v, got[i]) for i, v in enumerate(values) if got[i] != f"{v:.{digits}f}"]
    assert not wrong, wrong[:5]
    assert spark.sql("SELECT cast(NULL AS double) AS v").select(F.expr(fixed("v", digits))).first()[0] is None
