"""DuckDB statements that must give the same rows as the queries of the same name."""

from __future__ import annotations

from checks.tables import PARAMS
from sagline.operators.classes import CLASS_NAMES
from sagline.schema import Params

ORACLES: dict[str, str] = {}

PC = """pc AS (
  SELECT 'embeddings' AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
         embedding[3]::DOUBLE AS z, label AS classification FROM embeddings)"""
SEG = """seg AS (
  SELECT user_id AS seg_id, event_id AS point_id, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS x,
         0.1 * ((epoch_us(ts) - 1704067200000000) / 3600000000.0) + event_id % 7 AS y, value AS z FROM events)"""
LOTS = """lots AS (
  SELECT l_returnflag AS cloud_id, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z,
         l_linenumber AS classification FROM lineitem)"""


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def names_case(code: str) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLASS_NAMES.items())
    return f"CASE {code} {arms} ELSE 'Class ' || ({code})::VARCHAR END"


def clamp(e: str) -> str:
    return f"CASE WHEN {e} < -1 THEN -1.0 WHEN {e} > 1 THEN 1.0 ELSE {e} END"


def threshold(src: str) -> str:
    """``hist(bin, n, center)`` and ``thr(threshold)`` of one cloud."""
    return f"""
span AS (SELECT min(z) AS z0, max(z) AS z1, (max(z) - min(z)) / 50.0 AS w FROM {src}),
binned AS (SELECT greatest(1, least(50, ceil((z - z0) / w)))::INT AS bin FROM {src}, span),
hist AS (SELECT g.bin::INT AS bin, z0 + (g.bin - 0.5) * w AS center, count(b.bin) AS n
         FROM range(1, 51) g(bin) CROSS JOIN span LEFT JOIN binned b ON b.bin = g.bin GROUP BY g.bin, z0, w),
mode AS (SELECT bin, n FROM hist ORDER BY n DESC, bin LIMIT 1),
thr AS (SELECT mode.bin, mode.n, hist.center AS threshold FROM mode JOIN hist ON hist.bin = mode.bin + 3)"""


def eigen(src: str) -> str:
    """``eig``: l1, l2, l3, ex, ey, ez of the symmetric matrix cxx, cxy, cxz, cyy, cyz, czz in ``src``."""
    return f"""
g1 AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM {src}),
g2 AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q)
                       + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM g1),
g3 AS (SELECT *, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz)
                  + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) AS rr FROM g2 WHERE p > 0),
g4 AS (SELECT *, acos({clamp('rr')}) / 3 AS phi FROM g3),
g5 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM g4),
g6 AS (SELECT *, 3 * q - l1 - l3 AS l2,
         cxy * cyz - cxz * (cyy - l1) AS ax, cxz * cxy - (cxx - l1) * cyz AS ay, (cxx - l1) * (cyy - l1) - cxy * cxy AS az,
         cxy * (czz - l1) - cxz * cyz AS bx, cxz * cxz - (cxx - l1) * (czz - l1) AS by_, (cxx - l1) * cyz - cxy * cxz AS bz,
         (cyy - l1) * (czz - l1) - cyz * cyz AS kx, cyz * cxz - cxy * (czz - l1) AS ky, cxy * cyz - (cyy - l1) * cxz AS kz FROM g5),
g7 AS (SELECT *, ax * ax + ay * ay + az * az AS na, bx * bx + by_ * by_ + bz * bz AS nb, kx * kx + ky * ky + kz * kz AS nk FROM g6),
eig AS (SELECT * EXCLUDE (q, p, rr, phi, ax, ay, az, bx, by_, bz, kx, ky, kz, na, nb, nk),
         CASE WHEN na >= nb AND na >= nk THEN ax / sqrt(na) WHEN nb >= nk THEN bx / sqrt(nb) ELSE kx / sqrt(nk) END AS ex,
         CASE WHEN na >= nb AND na >= nk THEN ay / sqrt(na) WHEN nb >= nk THEN by_ / sqrt(nb) ELSE ky / sqrt(nk) END AS ey,
         CASE WHEN na >= nb AND na >= nk THEN az / sqrt(na) WHEN nb >= nk THEN bz / sqrt(nb) ELSE kz / sqrt(nk) END AS ez FROM g7)"""


COV = ("covar_samp(x, x) AS cxx, covar_samp(x, y) AS cxy, covar_samp(x, z) AS cxz, covar_samp(y, y) AS cyy, "
       "covar_samp(y, z) AS cyz, covar_samp(z, z) AS czz")


def axis(src: str = "seg") -> str:
    """``axis``: principal direction of each segment, turned to ey >= 0, with its angle."""
    return f"""
cov AS (SELECT seg_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {COV} FROM {src} GROUP BY seg_id),
{eigen('cov')},
axis AS (SELECT seg_id, n, mx, my, mz, l1, CASE WHEN ey < 0 THEN -ex ELSE ex END AS ex, abs(ey) AS ey,
           CASE WHEN ey < 0 THEN -ez ELSE ez END AS ez,
           degrees(acos({clamp('(CASE WHEN ey < 0 THEN -ex ELSE ex END)')})) AS angle FROM eig)"""


ALIGNED = """
al AS (SELECT seg.seg_id, point_id, n, mx, my, mz, cos(radians(angle)) AS c, sin(radians(angle)) AS s,
         (x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle)) AS u, z - mz AS v
       FROM seg JOIN axis USING (seg_id))"""


def fit(src: str, key: str, u: str, v: str) -> str:
    """``fit``: degree-2 fit of v on u per key: n, mu, sd, mv, p2, p1, p0 (scaled u), sse, sst."""
    return f"""
f1 AS (SELECT {key} AS k, count(*)::DOUBLE AS n, avg({u}) AS mu, stddev_samp({u}) AS sd, avg({v}) AS mv FROM {src} GROUP BY {key}),
f2 AS (SELECT f1.*, ({u} - mu) / sd AS t, {v} - mv AS w FROM {src} JOIN f1 ON {key} = k),
f3 AS (SELECT k, n, mu, sd, mv, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(w) AS t0,
         sum(t*w) AS t1, sum(t*t*w) AS t2, sum(w*w) AS sst FROM f2 GROUP BY k, n, mu, sd, mv),
f4 AS (SELECT *, s4 * (s2*n - s1*s1) - s3 * (s3*n - s1*s2) + s2 * (s3*s1 - s2*s2) AS det FROM f3),
f5 AS (SELECT k, n, mu, sd, mv, sst,
         (t2 * (s2*n - s1*s1) - s3 * (t1*n - s1*t0) + s2 * (t1*s1 - s2*t0)) / det AS p2,
         (s4 * (t1*n - s1*t0) - t2 * (s3*n - s1*s2) + s2 * (s3*t0 - t1*s2)) / det AS p1,
         (s4 * (s2*t0 - t1*s1) - s3 * (s3*t0 - t1*s2) + t2 * (s3*s1 - s2*s2)) / det AS p0 FROM f4),
f6 AS (SELECT f5.k, sum(pow(w - (p2*t*t + p1*t + p0), 2)) AS sse FROM f5 JOIN f2 ON f2.k = f5.k GROUP BY f5.k),
fit AS (SELECT f5.*, p0 + mv AS c0, sse FROM f5 JOIN f6 ON f5.k = f6.k)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


oracle("read_points", f"WITH {PC} SELECT * FROM pc")

oracle("split_ground", f"WITH {PC}, {threshold('pc')} SELECT point_id, z <= threshold AS is_ground FROM pc, thr")

oracle("above_ground_count", f"""WITH {PC}, {threshold('pc')}
SELECT {r('threshold')}, count(*) FILTER (z > threshold)::BIGINT AS above, count(*) FILTER (z <= threshold)::BIGINT AS ground
FROM pc, thr GROUP BY threshold""")

oracle("validate_mask", f"WITH {PC}, {threshold('pc')} SELECT count(*) AS n FROM pc, thr WHERE z > threshold")

NEAR = f"""near AS (SELECT a.cloud_id, a.point_id AS q_id, b.point_id AS n_id, b.x AS x, b.y AS y, b.z AS z,
  pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) AS dist2 FROM pc a, pc b
  WHERE pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) <= 0.1 * 0.1)"""

oracle("radius_join", f"WITH {PC}, {NEAR} SELECT q_id, n_id, {r('dist2')} FROM near")

oracle("local_covariance", f"""WITH {PC}, {NEAR}, cov AS (SELECT q_id AS point_id, count(*) AS n, {COV} FROM near GROUP BY q_id)
SELECT point_id, n, {', '.join(f"CASE WHEN n >= 3 THEN round({c}, 8) + 0.0 END AS {c}" for c in ('cxx', 'cxy', 'cxz', 'cyy', 'cyz', 'czz'))} FROM cov""")

SHAPE = f"""cov AS (SELECT q_id AS point_id, count(*) AS n, {COV} FROM near GROUP BY q_id HAVING count(*) >= 3),
{eigen('cov')},
shape AS (SELECT *, (l1 - l2) / l1 AS linearity, (l2 - l3) / l1 AS planarity, l3 / l1 AS sphericity,
  abs(degrees(acos({clamp('ez')})) - 90) AS slope FROM eig)"""

oracle("local_shape", f"""WITH {PC}, {NEAR}, {SHAPE}, every AS (SELECT q_id AS point_id, count(*) AS n FROM near GROUP BY q_id)
SELECT point_id, every.n, {r('l1', 8)}, {r('l2', 8)}, {r('l3', 8)}, {r('linearity', 5)}, {r('planarity', 5)}, {r('sphericity', 5)}, {r('slope', 3)}
FROM every LEFT JOIN shape USING (point_id)""")

oracle("line_candidates", f"""WITH {PC}, {NEAR}, {SHAPE}
SELECT point_id, classification FROM pc JOIN shape USING (point_id) WHERE slope < 30 AND linearity > 0.5""")

oracle("filter_class", f"WITH {PC} SELECT point_id, {r('x')}, {r('y')}, {r('z')}, classification FROM pc WHERE classification IN (2, 7)")


def reach(distance: str) -> str:
    return f"""RECURSIVE {PC}, edge AS (SELECT a.point_id AS u, b.point_id AS v FROM pc a, pc b
  WHERE pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) <= {distance} * {distance}),
walk(point_id, root) AS (SELECT point_id, point_id FROM pc UNION SELECT v, root FROM walk JOIN edge ON u = walk.point_id WHERE root < v),
lab AS (SELECT point_id, min(root) AS cluster_id FROM walk GROUP BY point_id)"""


oracle("euclidean_clusters", f"WITH {reach('0.05')} SELECT point_id, cluster_id FROM lab")
oracle("min_cluster_size", f"""WITH {reach('0.04')}
SELECT point_id, cluster_id FROM lab WHERE cluster_id IN (SELECT cluster_id FROM lab GROUP BY cluster_id HAVING count(*) >= 15)""")
oracle("cluster_points", f"""WITH {reach('0.05')} SELECT point_id, cluster_id FROM lab
WHERE cluster_id IN (SELECT cluster_id FROM lab GROUP BY cluster_id HAVING count(*) BETWEEN 2 AND 20)""")

CELL = "floor(floor({c} / (0.05 / sqrt(3.0) * (1.0 - 1e-9) / 4096)) / 4096)"
oracle("link_join", f"""WITH {PC}, keyed AS (SELECT *, {CELL.format(c='x')} AS kx, {CELL.format(c='y')} AS ky, {CELL.format(c='z')} AS kz FROM pc),
node AS (SELECT *, min(point_id) OVER (PARTITION BY kx, ky, kz) AS node FROM keyed)
SELECT DISTINCT a.node AS node_a, b.node AS node_b FROM node a, node b
WHERE a.node < b.node AND pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) <= 0.05 * 0.05""")

oracle("nearest_join", f"""WITH {PC}, d AS (SELECT q.point_id AS q_id, n.point_id AS n_id,
  pow(n.x - q.x, 2) + pow(n.y - q.y, 2) + pow(n.z - q.z, 2) AS d2 FROM pc q, pc n WHERE q.classification = 0 AND n.classification > 0)
SELECT q_id, n_id, round(sqrt(d2), 6) + 0.0 AS dist FROM d QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY d2, n_id) = 1""")
oracle("nearest_join_vertical", f"""WITH {PC}, d AS (SELECT q.point_id AS q_id, n.point_id AS n_id, q.z - n.z AS fall,
  pow(n.x - q.x, 2) + pow(n.y - q.y, 2) AS d2 FROM pc q, pc n WHERE q.classification = 0 AND n.classification > 0)
SELECT q_id, n_id, round(fall, 6) + 0.0 AS dist FROM d QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY d2, n_id) = 1""")

LENGTH = f"""{axis()},
len AS (SELECT seg_id, count(*) AS n, CASE WHEN count(*) < 3 THEN 0.0
  ELSE max((x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle))) - min((x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle))) END AS length
  FROM seg JOIN axis USING (seg_id) GROUP BY seg_id)"""

oracle("min_length", f"WITH {SEG}, {LENGTH} SELECT seg_id, point_id FROM seg JOIN len USING (seg_id) WHERE length >= 718")
oracle("segment_length", f"WITH {SEG}, {LENGTH} SELECT seg_id, n, {r('length', 4)} FROM len")
oracle("total_length", f"WITH {SEG}, {LENGTH} SELECT round(sum(length), 3) + 0.0 AS total_length FROM len")

oracle("class_name", f"WITH {PC} SELECT point_id, {names_case('classification * 3')} AS name FROM pc")

oracle("center_points", f"""WITH {SEG} SELECT seg_id, point_id,
{', '.join(f"round({c} - avg({c}) OVER (PARTITION BY seg_id), 8) + 0.0 AS {c}" for c in 'xyz')} FROM seg""")

oracle("rotate_z", f"""WITH {PC}, a AS (SELECT *, radians(classification * 36.5) AS t FROM pc)
SELECT point_id, {r('x * cos(t) - y * sin(t)', 6, 'x')}, {r('x * sin(t) + y * cos(t)', 6, 'y')}, {r('z')} FROM a""")

oracle("systematic_sample", f"""WITH {SEG} SELECT seg_id, point_id FROM seg
QUALIFY (row_number() OVER (PARTITION BY seg_id ORDER BY point_id) - 1) % 10 = 0""")

XY = """m AS (SELECT seg_id, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y,
  0.5 * atan2(2 * covar_pop(x, y), covar_pop(x, x) - covar_pop(y, y)) AS a FROM seg GROUP BY seg_id),
u AS (SELECT seg_id, n, mean_x, mean_y, cos(a) AS ux, sin(a) AS uy FROM m),
pt AS (SELECT seg_id, point_id, z, n, mean_x, mean_y, ux, uy, (x - mean_x) * ux + (y - mean_y) * uy AS tt,
         (y - mean_y) * ux - (x - mean_x) * uy AS perp FROM seg JOIN u USING (seg_id)),
pj AS (SELECT *, tt - min(tt) OVER (PARTITION BY seg_id) AS t FROM pt)"""

oracle("xy_axis", f"WITH {SEG}, {XY} SELECT seg_id, n, {r('mean_x')}, {r('mean_y')}, {r('ux')}, {r('uy')} FROM u")
oracle("project_along_axis", f"WITH {SEG}, {XY} SELECT seg_id, point_id, {r('t', 5)}, {r('perp', 5)} FROM pj")
oracle("sort_along_axis", f"""WITH {SEG}, {XY}
SELECT seg_id, point_id, row_number() OVER (PARTITION BY seg_id ORDER BY t, point_id) AS rank FROM pj""")

FIT = fit("seg", "seg_id", "x", "z")
oracle("polyfit2", f"""WITH {SEG}, {FIT} SELECT k AS seg_id, n::BIGINT AS n, {r('p2', 5, 'p0')}, {r('p1', 5, 'p1')}, {r('c0', 5, 'p2')},
{r('sqrt(sse)', 4, 'normr')}, n - 3 AS df, {r('1 - sse / sst', 6, 'rsq')}, {r('mu', 5, 'mu_mean')}, {r('sd', 5, 'mu_std')} FROM fit""")
oracle("polyfit2_lots", f"""WITH {LOTS}, {fit('lots', 'cloud_id', 'x', 'z')} SELECT k AS cloud_id, n::BIGINT AS n, {r('p2', 5, 'p0')},
{r('p1', 5, 'p1')}, {r('c0', 5, 'p2')}, {r('sqrt(sse)', 3, 'normr')}, {r('1 - sse / sst', 6, 'rsq')} FROM fit""")
oracle("polyfit2_along", f"""WITH {SEG}, {axis()}, {ALIGNED}, {fit('al', 'seg_id', 'u', 'v')}, back AS (SELECT fit.*, mz FROM fit JOIN axis ON k = seg_id)
SELECT k AS seg_id, {r('p2', 3, 'p0')}, {r('p1', 3, 'p1')}, {r('c0 + mz', 3, 'p2')}, {r('sqrt(sse)', 3, 'normr')} FROM back""")
oracle("r_squared", f"WITH {SEG}, {FIT} SELECT k AS seg_id, {r('1 - sse / sst', 6, 'rsq')} FROM fit")
oracle("fit_rmse", f"""WITH {SEG}, {axis()}, {ALIGNED}, {fit('al', 'seg_id', 'u', 'v')}
SELECT k AS seg_id, n::BIGINT AS n, CASE WHEN n < 10 THEN 10.0 ELSE round(sqrt(sse / n), 4) + 0.0 END AS rmse FROM fit""")
oracle("polyfit_order", f"""WITH {SEG}, s AS (SELECT seg_id, avg(x) AS mx, stddev_samp(x) AS sd FROM seg GROUP BY seg_id),
l AS (SELECT seg_id, regr_slope(z, (x - mx) / sd) AS p0, regr_intercept(z, (x - mx) / sd) AS p1 FROM seg JOIN s USING (seg_id) GROUP BY seg_id),
e AS (SELECT seg_id, sqrt(sum(pow(z - p0 * (x - mx) / sd - p1, 2))) AS normr FROM seg JOIN s USING (seg_id) JOIN l USING (seg_id) GROUP BY seg_id)
SELECT seg_id, {r('p0', 5)}, {r('p1', 8)}, {r('normr', 4)}, 1 AS n_order FROM l JOIN e USING (seg_id)""")

oracle("size_guards", f"""WITH base AS (SELECT * FROM (WITH {SEG} SELECT * FROM seg) WHERE z < 1), seg AS (SELECT * FROM base),
num AS (SELECT seg_id, count(*) AS n FROM seg GROUP BY seg_id),
big AS (SELECT seg.* FROM base seg JOIN num USING (seg_id) WHERE n >= 3),
{axis('big')},
len AS (SELECT seg_id, max((x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle))) - min((x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle))) AS length
  FROM big JOIN axis USING (seg_id) GROUP BY seg_id)
SELECT seg_id, num.n, CASE WHEN num.n < 3 THEN 0.0 ELSE round(length, 4) + 0.0 END AS length, 10.0 AS rmse
FROM num LEFT JOIN len USING (seg_id)""")

oracle("wire_report", f"""WITH {SEG}, {FIT}, low AS (SELECT seg_id AS k, min(z) AS clearance FROM seg GROUP BY seg_id)
SELECT k::INT AS wire_id, printf('=== Wire %d ===', k + 1) || chr(10)
  || printf('p = [%.6f  %.6f  %.6f]', p2, p1, c0) || chr(10)
  || printf('S.normr = %.6f | S.df = %d | S.rsquared = %.4f', sqrt(sse), (n - 3)::BIGINT, 1 - sse / sst) || chr(10)
  || printf('mu = [mean=%.6f, std=%.6f]', mu, sd) || chr(10) || chr(10)
  || printf('Ground clearance (lowest point): %.3f m', clearance) AS report FROM fit JOIN low USING (k)""")

oracle("attach_fit", f"""WITH {SEG}, {FIT}, w AS (SELECT DISTINCT seg_id FROM seg)
SELECT seg_id::INT AS wire_id, {r('sqrt(sse)', 4, 'normr')}, n - 3 AS df FROM w LEFT JOIN fit ON k = seg_id AND k < 100""")

RANK = """cnt AS (SELECT seg_id, row_number() OVER (ORDER BY seg_id) AS pos, count(*) AS count FROM seg GROUP BY seg_id),
rk AS (SELECT *, row_number() OVER (ORDER BY count DESC, pos) AS ord FROM cnt)"""
oracle("rank_segments", f"WITH {SEG}, {RANK} SELECT seg_id, pos, count, ord FROM rk")
oracle("rerank_after_merge", f"""WITH {SEG}, {RANK}, kept AS (SELECT seg_id, count, row_number() OVER (ORDER BY pos) AS pos FROM rk WHERE seg_id % 4 <> 1),
st AS (SELECT kept.*, rk.count AS stale FROM kept JOIN rk ON rk.pos = kept.pos)
SELECT seg_id, pos, count, row_number() OVER (ORDER BY stale DESC, pos) AS ord FROM st""")
oracle("merge_gate_join", f"""WITH {SEG}, {RANK}, s AS (SELECT seg_id, ord, rk.count AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, regr_slope(y, x) AS slope
  FROM seg JOIN rk USING (seg_id) GROUP BY seg_id, ord, rk.count)
SELECT a.seg_id AS a, b.seg_id AS b, a.ord AS oa, b.ord AS ob FROM s a, s b WHERE a.ord < b.ord AND a.n >= 10
AND abs(a.my + a.slope * (b.mx - a.mx) - b.my) < 0.05 - 1e-9 AND abs(a.mz - b.mz) < 1.0 - 1e-9""")
oracle("drop_absorbed", f"""WITH {SEG}, {RANK} SELECT seg_id, count FROM rk
WHERE seg_id NOT IN (SELECT seg_id + 1 FROM rk WHERE seg_id % 5 = 0 UNION ALL SELECT seg_id + 3 FROM rk WHERE seg_id % 5 = 0)""")

oracle("class_dimension_join", f"""WITH {LOTS} SELECT cloud_id, classification, count(*) AS n, {names_case('classification')} AS name
FROM lots GROUP BY cloud_id, classification""")

oracle("z_histogram", f"""WITH {LOTS}, span AS (SELECT cloud_id, min(z) AS z0, (max(z) - min(z)) / 50.0 AS w FROM lots GROUP BY cloud_id),
binned AS (SELECT cloud_id, greatest(1, least(50, ceil((z - z0) / w)))::INT AS bin FROM lots JOIN span USING (cloud_id)),
grid AS (SELECT cloud_id, g.bin::INT AS bin, z0 + (g.bin - 0.5) * w AS center FROM span CROSS JOIN range(1, 51) g(bin))
SELECT cloud_id, bin, {r('any_value(center)', 8, 'center')}, count(binned.bin) AS n FROM grid LEFT JOIN binned USING (cloud_id, bin) GROUP BY cloud_id, bin""")
oracle("modal_bin", f"WITH {PC}, {threshold('pc')} SELECT bin, n, {r('threshold')} FROM thr")

oracle("principal_axis", f"WITH {SEG}, {axis()} SELECT seg_id, n, {r('l1', 4)}, {r('ex', 4)}, {r('ey', 4)}, {r('ez', 4)}, {r('angle', 4)} FROM axis")
oracle("segment_count", f"WITH {SEG} SELECT seg_id, count(*) AS count FROM seg GROUP BY seg_id")
oracle("linefit_xy", f"""WITH {SEG}, m AS (SELECT seg_id, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS slope FROM seg GROUP BY seg_id)
SELECT seg_id, {r('slope')}, {r('my - slope * mx', 6, 'intercept')} FROM m""")
oracle("distinct_classes", f"WITH {PC} SELECT classification, count(*) AS n FROM pc GROUP BY classification")

BOUNDS = ", ".join([f"round({f}({a}), 6) + 0.0 AS {a}{f}" for a in "xyz" for f in ("min", "max")]
                   + [f"round((min({a}) + max({a})) / 2, 6) + 0.0 AS c{a}" for a in "xyz"])
oracle("bounds", f"WITH {LOTS} SELECT cloud_id, {BOUNDS} FROM lots GROUP BY cloud_id")
oracle("summarise_classes", f"""WITH {LOTS}, b AS (SELECT cloud_id, {BOUNDS} FROM lots GROUP BY cloud_id),
c AS (SELECT cloud_id, classification AS value, {names_case('classification')} AS name, count(*) AS n FROM lots GROUP BY cloud_id, classification)
SELECT * FROM c JOIN b USING (cloud_id)""")

oracle("lowest_point", f"""WITH {SEG} SELECT seg_id, {r('x', 5)}, {r('y', 5)}, {r('z', 5)} FROM seg
QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY seg.z, point_id) = 1""")
oracle("segment_means", f"""WITH {SEG} SELECT seg_id, count(*) AS n, {r('avg(x)', 8, 'mean_x')}, {r('avg(y)', 8, 'mean_y')}, {r('avg(z)', 8, 'mean_z')}
FROM seg GROUP BY seg_id""")
oracle("max_abs_residual", f"""WITH {SEG}, {axis()}, {ALIGNED}, {fit('al', 'seg_id', 'u', 'v')},
pr AS (SELECT axis.seg_id AS a, b.seg_id AS b, fit.*, mx, my, mz, cos(radians(angle)) AS c, sin(radians(angle)) AS s
       FROM axis JOIN fit ON k = axis.seg_id JOIN (SELECT DISTINCT seg_id FROM seg) b ON b.seg_id = axis.seg_id + 1),
tt AS (SELECT a, b, (((x - mx) * c + (y - my) * s) - mu) / sd AS t, p2, p1, c0, z - mz AS v FROM pr JOIN seg ON seg.seg_id = b)
SELECT a, b, {r('max(abs(p2 * t * t + p1 * t + c0 - v))', 3, 'worst')} FROM tt GROUP BY a, b""")
oracle("collect_segments", f"""WITH {SEG} SELECT seg_id, (point_id // 2000)::BIGINT AS chunk, count(*) AS count,
string_agg(point_id::VARCHAR, ',' ORDER BY point_id) AS point_ids FROM seg GROUP BY seg_id, point_id // 2000""")
oracle("output_shape", f"""WITH {PC}, {SEG}, {threshold('pc')}
SELECT 'above' AS output, count(*) AS rows FROM pc, thr WHERE z > threshold
UNION ALL SELECT 'ground', count(*) FROM pc, thr WHERE z <= threshold
UNION ALL SELECT 'segments', count(DISTINCT seg_id) FROM seg""")

oracle("split_by_position", f"""WITH {SEG}, k AS (SELECT seg_id, point_id, row_number() OVER (PARTITION BY seg_id ORDER BY x, point_id) AS i,
  count(*) OVER (PARTITION BY seg_id) AS n FROM seg)
SELECT seg_id, point_id, i <= n // 2 AS c1, i >= (2 * n) // 3 AS c2, i BETWEEN n // 2 AND (2 * n) // 3 AS c3 FROM k""")
GAP = """nx AS (SELECT *, lead(x) OVER o AS xn, lead(y) OVER o AS yn, lead(z) OVER o AS zn FROM seg WINDOW o AS (PARTITION BY seg_id ORDER BY point_id)),
gp AS (SELECT *, sqrt(pow(xn - x, 2) + pow(yn - y, 2) + pow(zn - z, 2)) AS gap FROM nx),
gn AS (SELECT *, floor(gap / 20.0)::BIGINT AS k FROM gp)"""
oracle("consecutive_gap", f"WITH {SEG}, {GAP} SELECT seg_id, point_id, {r('gap', 5)}, coalesce(k, 0) AS n_insert FROM gn")
oracle("fill_gaps", f"""WITH {SEG}, {GAP}, m AS (SELECT seg_id, avg(z) AS mz FROM seg GROUP BY seg_id),
new AS (SELECT seg_id, x + i * (xn - x) / (k + 1) AS x, mz FROM gn JOIN m USING (seg_id), LATERAL (SELECT unnest(range(1, k + 1)) AS i) WHERE k > 0)
SELECT seg_id, {r('x', 4)}, {r('y', 4)}, {r('z', 4)}, false AS inserted FROM seg
UNION ALL SELECT seg_id, round(x, 4) + 0.0, 0.0, round(0.25 * x + mz, 4) + 0.0, true FROM new""")

oracle("append_segments", f"""WITH {SEG}, both_ AS (SELECT * FROM seg WHERE z < 20 UNION ALL SELECT * FROM seg WHERE z > 10)
SELECT seg_id, count(*) AS n, {r('sum(z)', 3, 'sum_z')} FROM both_ GROUP BY seg_id""")
oracle("split_disjoint", f"""WITH {LOTS} SELECT CASE WHEN z > 40 THEN 'high' ELSE 'low' END AS output, count(*) AS rows FROM lots GROUP BY 1""")

oracle("evaluate_models", f"""WITH {PC} SELECT point_id, round(CASE classification % 3 WHEN 0 THEN 0.7 * x * x + 0.4 * x - 0.2
  WHEN 1 THEN 0.7 * cosh((x - 0.4) / (0.7 + 1e-12)) - 0.2 ELSE 0.7 + 0.4 * cosh((x + 0.2) / 0.4) END, 6) + 0.0 AS value FROM pc""")

oracle("densify_wire", f"""WITH {SEG}, {axis()}, {ALIGNED}, {fit('al', 'seg_id', 'u', 'v')},
ends AS (SELECT seg_id, max(u) AS hi, min(u) AS lo, floor((max(u) - min(u)) / 25.0)::BIGINT AS cnt FROM al GROUP BY seg_id),
g AS (SELECT axis.seg_id, i::INT AS sample, CASE WHEN cnt = 1 THEN lo ELSE hi - i * (hi - lo) / (cnt - 1) END AS u, mx, my, mz,
        cos(radians(angle)) AS c, sin(radians(angle)) AS s, mu, sd, p2, p1, c0
      FROM ends JOIN axis USING (seg_id) JOIN fit ON k = axis.seg_id, LATERAL (SELECT unnest(range(0, cnt)) AS i) WHERE cnt > 0)
SELECT seg_id, sample, {r('u * c + mx', 3, 'x')}, {r('u * s + my', 3, 'y')},
{r('p2 * pow((u - mu) / sd, 2) + p1 * (u - mu) / sd + c0 + mz', 3, 'z')} FROM g""")

oracle("sample_curve", f"""WITH {SEG}, {XY}, sp AS (SELECT seg_id, max(x) - min(x) AS span, max(z) AS c FROM seg GROUP BY seg_id),
g AS (SELECT u.*, span, c, i::INT AS sample, i * span / 299.0 AS t FROM u JOIN sp USING (seg_id), LATERAL (SELECT unnest(range(0, 300)) AS i))
SELECT seg_id::INT AS wire_id, sample, {r('mean_x + (t - span / 2.0) * ux', 4, 'x')}, {r('mean_y + (t - span / 2.0) * uy', 4, 'y')},
{r('350.0 * cosh((t - span / 3.0) / (350.0 + 1e-12)) + c', 4, 'z')} FROM g""")

oracle("interpolate_curve", f"""WITH {SEG}, {XY}, e AS (SELECT seg_id, min(tt) AS t0, max(tt) AS t1 FROM pj GROUP BY seg_id),
g AS (SELECT u.*, t0, i::INT AS sample, CASE WHEN i = 299 THEN t1 ELSE t0 + i * ((t1 - t0) / 299.0) END AS tt
      FROM u JOIN e USING (seg_id), LATERAL (SELECT unnest(range(0, 300)) AS i)),
lo AS (SELECT g.seg_id, sample, g.tt, g.mean_x, g.mean_y, g.ux, g.uy, l.tt AS lt, l.z AS lz FROM g ASOF JOIN pt_ l ON g.seg_id = l.seg_id AND g.tt >= l.tt),
hi AS (SELECT lo.seg_id, sample, lo.tt, lo.mean_x, lo.mean_y, lo.ux, lo.uy, lt, lz, h.tt AS ht, h.z AS hz FROM lo ASOF JOIN pt_ h ON lo.seg_id = h.seg_id AND lo.tt <= h.tt)
SELECT seg_id::INT AS wire_id, sample, {r('mean_x + tt * ux', 4, 'x')}, {r('mean_y + tt * uy', 4, 'y')},
{r('CASE WHEN ht > lt THEN lz + (tt - lt) / (ht - lt) * (hz - lz) ELSE hz END', 4, 'z')} FROM hi""".replace("pt_", "pj"))

ORACLES["ground_key"] = """
WITH a AS (
  SELECT user_id AS file, event_id AS pos,
    CASE WHEN user_id % 3 = 0 AND day(ts) = 5 THEN 'ground_points' ELSE strftime(ts, '%Y%m%d') END AS key FROM events)
SELECT file, key FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY key <> 'ground_points', pos) AS r FROM a) WHERE r = 1
"""
ORACLES["numeric_suffix_order"] = """
WITH w AS (
  SELECT CAST(user_id % 7 AS VARCHAR) AS cloud_id, user_id, 'wire_' || user_id AS key, count(*) AS count FROM events GROUP BY 1, 2, 3)
SELECT cloud_id, CAST(row_number() OVER o - 1 AS INTEGER) AS wire_id, key, CAST(row_number() OVER o - 1 AS INTEGER) AS label, count
FROM w WINDOW o AS (PARTITION BY cloud_id ORDER BY user_id)
"""
ORACLES["wire_info_records"] = """
SELECT CAST(user_id AS VARCHAR) AS cloud_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS wire_id,
  CAST(event_id AS DOUBLE) AS p0, user_id + 0.5::DOUBLE AS p1, 3::DOUBLE AS p2, 0.25::DOUBLE AS normr, CAST(event_id % 9 AS DOUBLE) AS df,
  CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE END AS rsq,
  CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id + 0.25::DOUBLE END AS mu_mean,
  CASE WHEN event_id % 2 = 0 THEN 2::DOUBLE ELSE 4::DOUBLE END AS mu_std
FROM events
"""


# --- passes, as a scan over the gates in order ----------------------------------------------------

def curve_of(points: str) -> str:
    """The parabola of a list of ``{u, v}``: centre, scale and coefficients as a struct, null without three places."""
    t = "(p.u - m.um) / m.sd"
    return f"""list_transform(list_transform([{points}], lambda q: {{'q': q, 'um': list_avg(list_transform(q, lambda p: p.u)),
  'sd': list_stddev_samp(list_transform(q, lambda p: p.u)), 'n': len(q)::DOUBLE}}), lambda m: {{'um': m.um, 'sd': m.sd, 'n': m.n,
  's1': list_sum(list_transform(m.q, lambda p: {t})), 's2': list_sum(list_transform(m.q, lambda p: pow({t}, 2))),
  's3': list_sum(list_transform(m.q, lambda p: pow({t}, 3))), 's4': list_sum(list_transform(m.q, lambda p: pow({t}, 4))),
  't0': list_sum(list_transform(m.q, lambda p: p.v)), 't1': list_sum(list_transform(m.q, lambda p: p.v * {t})),
  't2': list_sum(list_transform(m.q, lambda p: p.v * pow({t}, 2)))}})[1]"""


def merge_passes(passes: int, line: float, curve: float, height: float, seed: int = 10) -> str:
    """``k1``, ``k2`` ... and ``p1``, ``p2`` ...: segments and points after each pass over ``seg`` and ``rk``.

    Every gate is tried in the order of seed and candidate.
    """
    steps = ["p0 AS (SELECT seg_id, x, y, z FROM seg), k0 AS (SELECT seg_id, pos, count, ord FROM rk)"]
    for i in range(passes):
        steps.append(f"""
fr{i} AS (WITH {axis(f'p{i}')} SELECT seg_id, ord, axis.n, mx, my, mz, cos(radians(angle)) AS c, sin(radians(angle)) AS s, slope
  FROM axis JOIN k{i} USING (seg_id) JOIN (SELECT seg_id, regr_slope(y, x) AS slope FROM p{i} GROUP BY seg_id) USING (seg_id)),
mean{i} AS (SELECT seg_id, ord, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p{i} JOIN k{i} USING (seg_id) GROUP BY seg_id, ord),
ed{i} AS (SELECT a.seg_id AS a, b.seg_id AS b, row_number() OVER (ORDER BY a.ord, b.ord) AS i, a.mx, a.my, a.mz, a.c, a.s
  FROM fr{i} a JOIN mean{i} b ON a.ord < b.ord AND a.n >= {seed}
  AND abs(a.my + a.slope * (b.mx - a.mx) - b.my) < {line} AND abs(a.mz - b.mz) < {height}),
cand{i} AS MATERIALIZED (SELECT i, a, b, list({{'u': (x - mx) * c + (y - my) * s, 'v': z - mz}}) AS q
  FROM ed{i} JOIN p{i} ON seg_id = b GROUP BY i, a, b),
own{i} AS MATERIALIZED (SELECT seg_id AS a, list({{'u': (x - mx) * c + (y - my) * s, 'v': z - mz}}) AS q
  FROM fr{i} JOIN p{i} USING (seg_id) WHERE seg_id IN (SELECT a FROM ed{i}) GROUP BY seg_id),
rec{i} AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS b, false AS took, []::BIGINT[] AS gone, NULL::STRUCT(u DOUBLE, v DOUBLE)[] AS mine
  UNION ALL
  SELECT i, a, b, took, CASE WHEN took THEN list_append(gone, b) ELSE gone END, CASE WHEN took THEN list_concat(mine, q) ELSE mine END
  FROM (SELECT *, NOT list_contains(gone, a) AND NOT list_contains(gone, b) AND coalesce(list_max(list_transform(q, lambda p: abs(
          f.c2 * pow((p.u - f.um) / f.sd, 2) + f.c1 * (p.u - f.um) / f.sd + f.c0 - p.v))) < {curve}, false) AS took
    FROM (SELECT *, {{'um': g.um, 'sd': g.sd,
            'c2': (g.t2 * (g.s2*g.n - g.s1*g.s1) - g.s3 * (g.t1*g.n - g.s1*g.t0) + g.s2 * (g.t1*g.s1 - g.s2*g.t0)) / det,
            'c1': (g.s4 * (g.t1*g.n - g.s1*g.t0) - g.t2 * (g.s3*g.n - g.s1*g.s2) + g.s2 * (g.s3*g.t0 - g.t1*g.s2)) / det,
            'c0': (g.s4 * (g.s2*g.t0 - g.t1*g.s1) - g.s3 * (g.s3*g.t0 - g.t1*g.s2) + g.t2 * (g.s3*g.s1 - g.s2*g.s2)) / det}} AS f
      FROM (SELECT *, nullif(g.s4 * (g.s2*g.n - g.s1*g.s1) - g.s3 * (g.s3*g.n - g.s1*g.s2) + g.s2 * (g.s3*g.s1 - g.s2*g.s2), 0) AS det
        FROM (SELECT *, {curve_of('mine')} AS g
          FROM (SELECT c.i, c.a, c.b, c.q, r.gone, CASE WHEN r.a = c.a THEN r.mine ELSE o.q END AS mine
                FROM rec{i} r JOIN cand{i} c ON c.i = r.i + 1 JOIN own{i} o ON o.a = c.a)))))),
got{i} AS MATERIALIZED (SELECT a AS into_id, b AS seg_id FROM rec{i} WHERE took),
left{i} AS (SELECT seg_id, row_number() OVER (ORDER BY pos) AS pos, k.count + coalesce(gain, 0) AS count FROM k{i} k LEFT JOIN (
    SELECT into_id, sum(count) AS gain FROM got{i} JOIN k{i} USING (seg_id) GROUP BY into_id) ON into_id = seg_id
  WHERE seg_id NOT IN (SELECT seg_id FROM got{i})),
k{i + 1} AS MATERIALIZED (SELECT l.seg_id, l.pos, l.count::BIGINT AS count, row_number() OVER (ORDER BY k.count DESC, l.pos) AS ord
  FROM left{i} l JOIN k{i} k ON k.pos = l.pos),
p{i + 1} AS MATERIALIZED (SELECT coalesce(into_id, seg_id) AS seg_id, x, y, z FROM p{i} LEFT JOIN got{i} USING (seg_id))""")
    return ",".join(steps)


oracle("merge_pass", f"WITH RECURSIVE {SEG}, {RANK}, {merge_passes(1, 0.5, 260.0, 40.0)} SELECT seg_id, pos, count, ord FROM k1")
oracle("merge_segments", f"WITH RECURSIVE {SEG}, {RANK}, {merge_passes(3, 0.5, 260.0, 40.0)} SELECT seg_id, pos, count, ord FROM k3")


def linked(src: str, distance: float, out: str) -> str:
    """``out``: the points of ``src`` with the least point id that a chain of short steps reaches."""
    return f"""
e_{out} AS (SELECT a.point_id AS u, b.point_id AS v FROM {src} a, {src} b
  WHERE pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) <= {distance} * {distance}),
w_{out}(point_id, root) AS (SELECT point_id, point_id FROM {src} UNION SELECT v, root FROM w_{out} JOIN e_{out} ON u = w_{out}.point_id WHERE root < v),
{out} AS MATERIALIZED (SELECT s.*, label FROM {src} s JOIN (SELECT point_id, min(root) AS label FROM w_{out} GROUP BY point_id) USING (point_id))"""


def extraction(p: Params) -> str:
    """``wires`` (seg_id, wire_id, count, length) and ``onwire`` (wire_id, x, y, z) of the cloud."""
    near = f"pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) <= {p.radius} * {p.radius}"
    return f"""WITH RECURSIVE {PC}, up AS MATERIALIZED (WITH {threshold('pc')} SELECT pc.point_id, x, y, z FROM pc, thr WHERE z > threshold),
near AS (SELECT a.point_id AS q_id, b.x, b.y, b.z FROM up a, up b WHERE {near}),
lined AS MATERIALIZED (WITH {SHAPE} SELECT up.* FROM up JOIN shape USING (point_id) WHERE slope < {p.angle} AND linearity > {p.linearity}),
{linked('lined', p.cluster_distance, 'coarse')},
big AS (SELECT point_id, x, y, z FROM coarse WHERE label IN (SELECT label FROM coarse GROUP BY label HAVING count(*) >= {p.min_cluster})),
{linked('big', p.segment_distance, 'fine')},
seg AS MATERIALIZED (SELECT label AS seg_id, x, y, z FROM fine), {RANK}, {merge_passes(p.merge_passes, p.merge_line, p.merge_curve, p.merge_height, p.merge_seed)},
len AS (WITH {axis(f'p{p.merge_passes}')} SELECT seg_id, CASE WHEN any_value(n) < 3 THEN 0 ELSE
    max((x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle))) - min((x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle))) END AS length
  FROM p{p.merge_passes} JOIN axis USING (seg_id) GROUP BY seg_id),
wires AS MATERIALIZED (SELECT seg_id, (row_number() OVER (ORDER BY pos) - 1)::INT AS wire_id, count, length
  FROM k{p.merge_passes} JOIN len USING (seg_id) WHERE length >= {p.min_length}),
onwire AS MATERIALIZED (SELECT wire_id, x, y, z FROM p{p.merge_passes} JOIN wires USING (seg_id))"""


oracle("extract_lines", f"""{extraction(PARAMS)}, {fit('onwire', 'wire_id', 'x', 'z')}
SELECT wire_id, count, {r('length', 4)}, n - 3 AS df, {r('1 - sse / sst', 4, 'rsq')} FROM wires JOIN fit ON wire_id = k""")


# --- catenaries, by a grid of both shape parameters that closes in on its best point -----------------

ZOOM, SHRINK = 34, 0.6
GRID = "range(-6, 7) g(i), range(-6, 7) h(j)"

# For a vertex b and a curvature exp(lk) the best height is a mean, so the squared error is a variance.
oracle("fit_catenary", f"""WITH RECURSIVE {SEG}, {XY},
w AS MATERIALIZED (SELECT seg_id, tt AS t, z, min(tt) OVER s AS t0, max(tt) OVER s - min(tt) OVER s AS span, n FROM pj WINDOW s AS (PARTITION BY seg_id)),
start AS MATERIALIZED (SELECT DISTINCT seg_id, n, span, t0 - span - 1 AS lo, t0 + 2 * span + 1 AS hi FROM w WHERE n >= 4),
zoom AS (
  SELECT 0 AS step, seg_id, (lo + hi) / 2 AS b, (hi - lo) / 2 AS bw, (ln(1e-6) + ln(0.1)) / 2 AS lk, (ln(0.1) - ln(1e-6)) / 2 AS kw, NULL::DOUBLE AS sse FROM start
  UNION ALL
  SELECT step + 1, seg_id, best.b, bw * {SHRINK}, best.lk, kw * {SHRINK}, best.sse FROM (
    SELECT step, seg_id, bw, kw, min_by({{'b': b, 'lk': lk, 'sse': sse}}, sse) AS best FROM (
      SELECT step, seg_id, bw, kw, b, lk, count(*) * var_pop(z - cosh(exp(lk) * (t - b)) / exp(lk)) AS sse FROM (
        SELECT step, zoom.seg_id, bw, kw, greatest(lo, least(hi, b + i / 6.0 * bw)) AS b, greatest(ln(1e-6), lk + j / 6.0 * kw) AS lk
        FROM zoom JOIN start USING (seg_id), {GRID} WHERE step < {ZOOM}) JOIN w USING (seg_id)
      GROUP BY step, seg_id, bw, kw, b, lk) GROUP BY step, seg_id, bw, kw))
SELECT seg_id::INT AS wire_id, n, {r('span', 4)}, {r('sse', 1)}, 'catenary' AS method FROM zoom JOIN start USING (seg_id) WHERE step = {ZOOM}""")

# Points of one abscissa are one weighted point and their own scatter; s and k are slope and curvature at the mean.
oracle("fit_catenary_offset", f"""WITH RECURSIVE {LOTS},
w AS MATERIALIZED (SELECT cloud_id, x, count(*) AS m, avg(z) AS z, count(*) * var_pop(z) AS own FROM lots GROUP BY cloud_id, x),
start AS MATERIALIZED (SELECT cloud_id, count(*) AS n, avg(x) AS tm, avg(z) AS zm, regr_slope(z, x) AS s0 FROM lots GROUP BY cloud_id),
zoom AS (
  SELECT 0 AS step, cloud_id, s0 AS s, 0.5::DOUBLE AS sw, 1e-7::DOUBLE AS k, 0.05::DOUBLE AS kw, NULL::DOUBLE AS sse FROM start
  UNION ALL
  SELECT step + 1, cloud_id, best.s, sw * {SHRINK}, best.k, kw * {SHRINK}, best.sse FROM (
    SELECT step, cloud_id, sw, kw, min_by({{'s': s, 'k': k, 'sse': sse}}, sse) AS best FROM (
      SELECT step, cloud_id, sw, kw, s, k, sum(own) + sum(m * d * d) - pow(sum(m * d), 2) / sum(m) AS sse FROM (
        SELECT *, z - zm - (cosh(k * (x - tm) + asinh(s)) - cosh(asinh(s))) / k AS d FROM (
          SELECT step, cloud_id, sw, kw, s + i / 6.0 * sw AS s, k + j / 6.0 * kw AS k FROM zoom, {GRID} WHERE step < {ZOOM})
        JOIN w USING (cloud_id) JOIN start USING (cloud_id))
      GROUP BY step, cloud_id, sw, kw, s, k) GROUP BY step, cloud_id, sw, kw))
SELECT cloud_id, n, {r('sse', 0)} FROM zoom JOIN start USING (cloud_id) WHERE step = {ZOOM}""")

# ``zoom`` at its last step: mean residual h, slope s and curvature k at ``um`` of the points ``w`` (a, u, v) of each a.
FREE_FIT = f"""start AS MATERIALIZED (SELECT a, avg(u) AS um, regr_slope(v, u) AS s0 FROM w GROUP BY a),
zoom AS (
  SELECT 0 AS step, a, s0 AS s, 0.2::DOUBLE AS sw, 1e-7::DOUBLE AS k, 0.003::DOUBLE AS kw, 0.0::DOUBLE AS h FROM start
  UNION ALL
  SELECT step + 1, a, best.s, sw * {SHRINK}, best.k, kw * {SHRINK}, best.h FROM (
    SELECT step, a, sw, kw, min_by({{'s': s, 'k': k, 'h': h}}, sse) AS best FROM (
      SELECT step, a, sw, kw, s, k, avg(d) AS h, var_pop(d) AS sse FROM (
        SELECT *, v - (cosh(k * (u - um) + asinh(s)) - cosh(asinh(s))) / k AS d FROM (
          SELECT step, a, sw, kw, s + i / 6.0 * sw AS s, k + j / 6.0 * kw AS k FROM zoom, {GRID} WHERE step < {ZOOM})
        JOIN w USING (a) JOIN start USING (a))
      GROUP BY step, a, sw, kw, s, k) GROUP BY step, a, sw, kw))"""

oracle("pair_merge_test", f"""WITH RECURSIVE ax AS MATERIALIZED (WITH {SEG}, {axis()} SELECT * FROM axis), {SEG},
fr AS MATERIALIZED (SELECT seg_id AS a, n, mx, my, mz, cos(radians(angle)) AS c, sin(radians(angle)) AS s FROM ax),
w AS MATERIALIZED (SELECT a, (x - mx) * c + (y - my) * s AS u, z - mz AS v FROM seg JOIN fr ON a = seg_id WHERE n >= 3),
{FREE_FIT},
o AS (SELECT fr.a, seg_id AS b, (y - my) * c - (x - mx) * fr.s AS off, z - mz AS v, (x - mx) * c + (y - my) * fr.s AS u FROM seg JOIN fr ON seg_id = fr.a + 1),
g AS (SELECT a, b, avg(off) AS mean_off, avg(h + (cosh(k * (u - um) + asinh(s)) - cosh(asinh(s))) / k - v) AS mean_gap
  FROM o JOIN zoom USING (a) JOIN start USING (a) WHERE step = {ZOOM} GROUP BY a, b)
SELECT a, b, {r('mean_off', 3)}, {r('mean_gap', 2)}, (abs(mean_off) < 0.1 AND abs(mean_gap) < 0.1)::INT AS merge FROM g""")

oracle("predict_gap", f"""WITH RECURSIVE al AS MATERIALIZED (WITH {SEG},
    half AS (SELECT * FROM seg QUALIFY (row_number() OVER (PARTITION BY seg_id ORDER BY point_id) - 1) % 2 = 0), {axis('half')}
  SELECT seg_id, point_id, (x - mx) * cos(radians(angle)) + (y - my) * sin(radians(angle)) AS x, z - mz AS z FROM half JOIN axis USING (seg_id)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY x, point_id) AS i, count(*) OVER (PARTITION BY seg_id) AS n FROM al),
w AS MATERIALIZED (SELECT seg_id AS a, x AS u, z AS v FROM ranked WHERE i <= n // 2 UNION ALL SELECT seg_id, x, z FROM ranked WHERE i >= (2 * n) // 3),
{FREE_FIT},
span AS (SELECT seg_id AS a, min(x) AS lo, max(x) AS hi, floor((max(x) - min(x)) / 40.0)::BIGINT AS count FROM ranked
  WHERE i BETWEEN n // 2 AND (2 * n) // 3 GROUP BY seg_id),
grid AS (SELECT a, i::INT AS sample, CASE WHEN count = 1 THEN hi ELSE lo + i * (hi - lo) / (count - 1) END AS x
  FROM span, LATERAL (SELECT unnest(range(0, count)) AS i) WHERE count > 0)
SELECT a::INT AS wire_id, sample, {r('x', 1)}, {r('h + (cosh(k * (x - um) + asinh(s)) - cosh(asinh(s))) / k', 1, 'z')}
FROM grid JOIN zoom USING (a) JOIN start USING (a) WHERE step = {ZOOM}""")
