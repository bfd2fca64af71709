"""One query per operator. Floats are rounded, as both engines sum in their own order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import PARAMS, cloud, lots, segments, table, wires
from sagline.functions.geometry import acos_deg
from sagline.functions.models import polyval
from sagline.operators import catenary, classes, cluster, fit, generate, grid, ground, merge, ordering, report, shape
from sagline.operators import segments as seg_ops
from sagline.plans import class_summary, extract_power_lines, wire_summary
from sagline.sources import npz
from sagline.sources import wires as wires_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEG = ("cloud_id", "seg_id")
WIRE = ("cloud_id", "wire_id")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + 0.0


def quick_r(c: Column | str, digits: int = 6) -> Column:
    """:func:`r` of numbers from 0 on, for billions of rows: only near a half, or when large, does it take decimal arithmetic."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * 10.0 ** digits
    clear = (scaled < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(clear, F.floor(scaled + 0.5) / 10.0 ** digits).otherwise(r(c, digits))


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


# --- sources ------------------------------------------------------------------------------------

@query
def read_points(spark, sf):
    return cloud(spark, sf)


@query
def ground_key(spark, sf):
    """Users as archives, their days as arrays; those of user ids divisible by 3 have one named for ground."""
    day = F.date_format("ts", "yyyyMMdd")
    named = (F.col("user_id") % 3 == 0) & (F.dayofmonth("ts") == 5)
    arrays = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.when(named, "ground_points").otherwise(day).alias("key"),
                                               F.col("event_id").cast("int").alias("pos"))
    return npz.ground_keys(arrays)


@query
def numeric_suffix_order(spark, sf):
    rows = table(spark, sf, "events").groupBy(
        (F.col("user_id") % 7).cast("string").alias("cloud_id"), F.concat(F.lit("wire_"), F.col("user_id")).alias("key")).count()
    return npz.number_wires(rows)


@query
def wire_info_records(spark, sf):
    """A JSON array per user, its records in both forms of the location and scale."""
    head = F.format_string('{"p": [%d, %d.5, 3], "normr": 0.25, "df": %d, ', "event_id", "user_id", F.col("event_id") % 9)
    tail = F.when(F.col("event_id") % 2 == 0, F.format_string('"rsq": 0.5, "mu_mean": %d, "mu_std": 2}', "user_id")).otherwise(
        F.format_string('"mu": [%d.25, 4]}', "event_id"))
    text = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(head, tail).alias("t")))).alias("r"))
    text = text.select(F.col("user_id").cast("string").alias("cloud_id"), F.concat(F.lit("["), F.array_join(F.col("r.t"), ","), F.lit("]")).alias("value"))
    found = wires_source.normalise_fits(text.select("cloud_id", F.posexplode(wires_source.fit_records(F.col("value"))).alias("wire_id", "r")).select(
        "cloud_id", "wire_id", "r.*"))
    return found.select("cloud_id", "wire_id", *[F.col("p")[i].alias(f"p{i}") for i in range(3)], "normr", "df", "rsq", "mu_mean", "mu_std")


# --- projections and filters --------------------------------------------------------------------

@query
def split_ground(spark, sf):
    above, below = ground.split_ground(cloud(spark, sf))
    return above.select("point_id", F.lit(False).alias("is_ground")).unionByName(
        below.select("point_id", F.lit(True).alias("is_ground")))


@query
def above_ground_count(spark, sf):
    points = cloud(spark, sf)
    limits = ground.ground_threshold(points)
    above, below = ground.split_ground(points, limits=limits)
    both = above.withColumn("up", F.lit(1)).unionByName(below.withColumn("up", F.lit(0)))
    count = both.groupBy("cloud_id").agg(F.sum("up").alias("above"), F.sum(1 - F.col("up")).alias("ground"))
    return limits.join(count, "cloud_id").select(r("threshold").alias("threshold"), "above", "ground")


@query
def line_candidates(spark, sf):
    return shape.line_candidates(cloud(spark, sf), 0.1, 30.0, 0.5).select("point_id", "classification")


@query
def validate_mask(spark, sf):
    above, _ = ground.split_ground(cloud(spark, sf))
    return ground.validate_mask(above).agg(F.count(F.lit(1)).alias("n"))


@query
def filter_class(spark, sf):
    return rounded(classes.filter_class(cloud(spark, sf), [2, 7]), 6, "x", "y", "z").drop("cloud_id")


@query
def min_cluster_size(spark, sf):
    labelled = cluster.euclidean_clusters(cloud(spark, sf), 0.04)
    return seg_ops.min_cluster_size(labelled, 15).select("point_id", "cluster_id")


@query
def min_length(spark, sf):
    return seg_ops.min_length(segments(spark, sf), 718.0).select("seg_id", "point_id")


@query
def size_guards(spark, sf):
    few = segments(spark, sf).where("z < 1")
    length = seg_ops.segment_length(few).select("seg_id", "n", r("length", 4).alias("length"))
    rmse = fit.fit_rmse(few, SEG).select("seg_id", r("rmse", 4).alias("rmse"))
    return length.join(rmse, "seg_id")


@query
def class_name(spark, sf):
    code = F.col("classification") * 3
    return cloud(spark, sf).select("point_id", classes.class_name(code).alias("name"))


@query
def center_points(spark, sf):
    return rounded(seg_ops.center_points(segments(spark, sf), SEG), 8, "x", "y", "z").select("seg_id", "point_id", "x", "y", "z")


@query
def rotate_z(spark, sf):
    p = generate.rotate_z(cloud(spark, sf), F.radians(F.col("classification") * 36.5))
    return rounded(p, 6, "x", "y", "z").select("point_id", "x", "y", "z")


@query
def systematic_sample(spark, sf):
    return ordering.systematic_sample(segments(spark, sf), 10, SEG).select("seg_id", "point_id")


@query
def project_along_axis(spark, sf):
    p = generate.project_along_axis(segments(spark, sf), SEG)
    return p.select("seg_id", "point_id", r("t", 5).alias("t"), r("perp", 5).alias("perp"))


@query
def wire_report(spark, sf):
    w = wires(spark, sf)
    fits = fit.polyfit2(w, WIRE)
    low = w.groupBy(*WIRE).agg(F.min("z").alias("clearance"))
    return report.wire_report(fits.join(low, list(WIRE)), "wire_id", "clearance").select("wire_id", "report")


# --- joins --------------------------------------------------------------------------------------

@query
def radius_join(spark, sf):
    return grid.radius_join(cloud(spark, sf), 0.1).select("q_id", "n_id", quick_r("dist2").alias("dist2"))


@query
def link_join(spark, sf):
    return grid.link_join(cloud(spark, sf), 0.05).select("node_a", "node_b")


@query
def nearest_join(spark, sf):
    p = cloud(spark, sf)
    q = p.where("classification = 0").withColumnRenamed("point_id", "q_id")
    near = grid.nearest_join(q, p.where("classification > 0"), side=0.05)
    return near.select("q_id", "n_id", r("dist").alias("dist"))


@query
def nearest_join_vertical(spark, sf):
    p = cloud(spark, sf)
    q = p.where("classification = 0").withColumnRenamed("point_id", "q_id")
    near = grid.nearest_join(q, p.where("classification > 0"), side=0.05, metric="vertical")
    return near.select("q_id", "n_id", r("dist").alias("dist"))


@query
def merge_gate_join(spark, sf):
    s = segments(spark, sf)
    seg = merge.segment_frames(s).join(seg_ops.rank_segments(seg_ops.build_segments(s)), list(SEG))
    return merge.merge_gate_join(seg, 0.05, 1.0).select("a", "b", "oa", "ob")


@query
def attach_fit(spark, sf):
    w = wires(spark, sf)
    fits = fit.polyfit2(w.where("wire_id < 100"), WIRE).select(*WIRE, "normr", "df")
    return rounded(report.attach_fit(w.select(*WIRE).distinct(), fits), 4, "normr").select("wire_id", "normr", "df")


@query
def cluster_points(spark, sf):
    labelled = cluster.euclidean_clusters(cloud(spark, sf), 0.05)
    big = labelled.groupBy("cloud_id", "cluster_id").count().where("count between 2 and 20")
    return seg_ops.cluster_points(labelled, big).select("point_id", "cluster_id")


@query
def drop_absorbed(spark, sf):
    s = seg_ops.build_segments(segments(spark, sf))
    s = s.withColumn("ids", F.when(F.col("seg_id") % 5 == 0, F.array(F.col("seg_id") + 1, F.col("seg_id") + 3)).otherwise(F.col("ids")))
    return seg_ops.drop_absorbed(s).select("seg_id", "count")


@query
def class_dimension_join(spark, sf):
    present = classes.distinct_classes(lots(spark, sf))
    return classes.class_dimension_join(present, classes.class_dimension(spark))


# --- aggregates ---------------------------------------------------------------------------------

@query
def z_histogram(spark, sf):
    return rounded(ground.z_histogram(lots(spark, sf)), 8, "center")


@query
def modal_bin(spark, sf):
    return rounded(ground.modal_bin(ground.z_histogram(cloud(spark, sf))), 6, "threshold").drop("cloud_id")


@query
def local_covariance(spark, sf):
    return rounded(shape.local_covariance(cloud(spark, sf), 0.1), 8, *shape.COV).drop("cloud_id")


@query
def local_shape(spark, sf):
    s = shape.local_shape(cloud(spark, sf), 0.1)
    return s.select("point_id", "n", *[r(c, 8).alias(c) for c in ("l1", "l2", "l3")],
                    *[r(c, 5).alias(c) for c in ("linearity", "planarity", "sphericity")],
                    r(F.abs(acos_deg(F.col("ez")) - 90.0), 3).alias("slope"))


@query
def principal_axis(spark, sf):
    a = shape.principal_axis(segments(spark, sf), SEG)
    return a.select("seg_id", "n", *[r(c, 4).alias(c) for c in ("l1", "ex", "ey", "ez", "angle")])


@query
def segment_count(spark, sf):
    return seg_ops.segment_count(segments(spark, sf)).select("seg_id", "count")


@query
def xy_axis(spark, sf):
    a = shape.xy_axis(segments(spark, sf), SEG)
    return a.select("seg_id", "n", *[r(c, 6).alias(c) for c in ("mean_x", "mean_y", "ux", "uy")])


@query
def segment_length(spark, sf):
    return rounded(seg_ops.segment_length(segments(spark, sf)), 4, "length").drop("cloud_id")


@query
def total_length(spark, sf):
    return rounded(seg_ops.total_length(seg_ops.segment_length(segments(spark, sf))), 3, "total_length").drop("cloud_id")


@query
def polyfit2(spark, sf):
    f = fit.polyfit2(segments(spark, sf), SEG)
    return f.select("seg_id", "n", *[r(F.col("p")[i], 5).alias(f"p{i}") for i in range(3)], r("normr", 4).alias("normr"),
                    "df", r("rsq", 6).alias("rsq"), r("mu_mean", 5).alias("mu_mean"), r("mu_std", 5).alias("mu_std"))


@query
def polyfit2_lots(spark, sf):
    f = fit.polyfit2(lots(spark, sf), ["cloud_id"])
    return f.select("cloud_id", "n", *[r(F.col("p")[i], 5).alias(f"p{i}") for i in range(3)], r("normr", 3).alias("normr"),
                    r("rsq", 6).alias("rsq"))


@query
def polyfit2_along(spark, sf):
    f = fit.polyfit2(segments(spark, sf), SEG, axis="along")
    return f.select("seg_id", *[r(F.col("p")[i], 3).alias(f"p{i}") for i in range(3)], r("normr", 3).alias("normr"))


@query
def r_squared(spark, sf):
    return rounded(fit.r_squared(segments(spark, sf), SEG), 6, "rsq").drop("cloud_id")


@query
def linefit_xy(spark, sf):
    return rounded(fit.linefit_xy(segments(spark, sf), SEG), 6, "slope", "intercept").drop("cloud_id")


@query
def fit_rmse(spark, sf):
    return rounded(fit.fit_rmse(segments(spark, sf), SEG), 4, "rmse").drop("cloud_id")


@query
def distinct_classes(spark, sf):
    return classes.distinct_classes(cloud(spark, sf)).drop("cloud_id")


@query
def bounds(spark, sf):
    b = classes.bounds(lots(spark, sf))
    return rounded(b, 6, *[c for c in b.columns if c != "cloud_id"])


@query
def lowest_point(spark, sf):
    low = report.lowest_point(segments(spark, sf), SEG, order="point_id")
    return rounded(low, 5, "x", "y", "z").drop("cloud_id")


@query
def segment_means(spark, sf):
    return rounded(seg_ops.segment_means(segments(spark, sf)), 8, "mean_x", "mean_y", "mean_z").drop("cloud_id")


@query
def max_abs_residual(spark, sf):
    s = segments(spark, sf)
    pairs = s.select("cloud_id", F.col("seg_id").alias("a"), (F.col("seg_id") + 1).alias("b")).distinct()
    worst = merge.max_abs_residual(pairs, s, merge.segment_frames(s))
    return worst.select("a", "b", r("worst", 3).alias("worst"))


@query
def collect_segments(spark, sf):
    nested = seg_ops.collect_segments(segments(spark, sf), chunk=2000)
    ids = F.array_join(F.transform("location", lambda p: p["point_id"].cast("string")), ",")
    return nested.select("seg_id", "chunk", "count", ids.alias("point_ids"))


@query
def output_shape(spark, sf):
    above, below = ground.split_ground(cloud(spark, sf))
    return seg_ops.output_shape(above=above, ground=below, segments=seg_ops.build_segments(segments(spark, sf)))


# --- order --------------------------------------------------------------------------------------

@query
def rank_segments(spark, sf):
    return seg_ops.rank_segments(seg_ops.build_segments(segments(spark, sf))).select("seg_id", "pos", "count", "ord")


@query
def rerank_after_merge(spark, sf):
    before = seg_ops.rank_segments(seg_ops.build_segments(segments(spark, sf)))
    after = before.where("seg_id % 4 <> 1")
    return seg_ops.rerank_after_merge(before, after).select("seg_id", "pos", "count", "ord")


@query
def sort_along_axis(spark, sf):
    p = generate.project_along_axis(segments(spark, sf), SEG)
    return generate.sort_along_axis(p, SEG).select("seg_id", "point_id", "rank")


@query
def split_by_position(spark, sf):
    p = ordering.number_rows(segments(spark, sf), SEG, ["x", "point_id"], "rank")
    return generate.split_by_position(p, SEG).select("seg_id", "point_id", "c1", "c2", "c3")


@query
def consecutive_gap(spark, sf):
    g = generate.consecutive_gap(segments(spark, sf), 20.0, SEG)
    return g.select("seg_id", "point_id", r("gap", 5).alias("gap"), F.coalesce("n_insert", F.lit(0)).alias("n_insert"))


# --- sets ---------------------------------------------------------------------------------------

@query
def append_segments(spark, sf):
    s = segments(spark, sf)
    both = seg_ops.append_segments(s.where("z < 20"), s.where("z > 10"))
    return both.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("z"), 3).alias("sum_z"))


@query
def split_disjoint(spark, sf):
    high, low = ground.split_disjoint(lots(spark, sf), F.col("z") > 40)
    return seg_ops.output_shape(high=high, low=low)


# --- clusters and merging -----------------------------------------------------------------------

@query
def euclidean_clusters(spark, sf):
    return cluster.euclidean_clusters(cloud(spark, sf), 0.05).select("point_id", "cluster_id")


def _loose(spark, sf):
    s = segments(spark, sf)
    return seg_ops.rank_segments(seg_ops.build_segments(s)), s


@query
def merge_pass(spark, sf):
    seg, points = _loose(spark, sf)
    after, _, _ = merge.merge_pass(seg, points, line=0.5, curve=260.0, height=40.0)
    return after.select("seg_id", "pos", "count", "ord")


@query
def merge_segments(spark, sf):
    seg, points = _loose(spark, sf)
    after, _ = merge.merge_segments(seg, points, 3, line=0.5, curve=260.0, height=40.0)
    return after.select("seg_id", "pos", "count", "ord")


@query
def pair_merge_test(spark, sf):
    s = segments(spark, sf)
    pairs = s.select("cloud_id", F.col("seg_id").alias("a"), (F.col("seg_id") + 1).alias("b")).distinct()
    t = merge.pair_merge_test(pairs, s)
    return t.select("a", "b", r("mean_off", 3).alias("mean_off"), r("mean_gap", 2).alias("mean_gap"), "merge")


# --- curves -------------------------------------------------------------------------------------

@query
def fit_catenary(spark, sf):
    f = catenary.fit_catenary(wires(spark, sf), WIRE)
    return f.select("wire_id", "n", r("span", 4).alias("span"), r("sse", 1).alias("sse"), "method")


@query
def fit_catenary_offset(spark, sf):
    f = catenary.fit_catenary_offset(lots(spark, sf), ["cloud_id"])
    return f.select("cloud_id", "n", r("sse", 0).alias("sse"))


@query
def evaluate_models(spark, sf):
    p = cloud(spark, sf).withColumn("k", F.col("classification") % 3)
    model = F.when(F.col("k") == 0, "polynomial").when(F.col("k") == 1, "catenary").otherwise("catenary_offset")
    coef = F.array(F.lit(0.7), F.lit(0.4), F.lit(-0.2))
    return p.select("point_id", r(polyval(model, coef, F.col("x"))).alias("value"))


@query
def polyfit_order(spark, sf):
    f = fit.polyfit_order(segments(spark, sf), SEG, degree=1)
    return f.select("seg_id", *[r(F.col("p")[i], (5, 8)[i]).alias(f"p{i}") for i in range(2)], r("normr", 4).alias("normr"), "n_order")


@query
def densify_wire(spark, sf):
    d = generate.densify_wire(segments(spark, sf), 25.0, SEG)
    return rounded(d, 3, "x", "y", "z").drop("cloud_id")


@query
def fill_gaps(spark, sf):
    s = segments(spark, sf)
    flat = s.groupBy(*SEG).agg(F.array(F.lit(0.0), F.lit(0.25), F.avg("z")).alias("p"))
    return rounded(generate.fill_gaps(s, flat, 20.0, SEG), 4, "x", "y", "z").drop("cloud_id")


@query
def sample_curve(spark, sf):
    w = wires(spark, sf)
    axis = shape.xy_axis(w, WIRE)
    span = w.groupBy(*WIRE).agg((F.max("x") - F.min("x")).alias("span"), F.max("z").alias("c"))
    fits = axis.join(span, list(WIRE)).withColumns({
        "a": F.lit(350.0), "b": F.col("span") / 3.0, "t0": -F.col("span") / 2.0, "method": F.lit("catenary")})
    return rounded(generate.sample_curve(fits, 300, WIRE), 4, "x", "y", "z").drop("cloud_id")


@query
def interpolate_curve(spark, sf):
    c = generate.interpolate_curve(wires(spark, sf), 300, WIRE)
    return rounded(c, 4, "x", "y", "z").drop("cloud_id")


@query
def predict_gap(spark, sf):
    return rounded(generate.predict_gap(wires(spark, sf), WIRE, every=2, spacing=40.0), 1, "x", "z").select("wire_id", "sample", "x", "z")


# --- plans --------------------------------------------------------------------------------------

@query
def extract_lines(spark, sf):
    out = extract_power_lines(cloud(spark, sf), PARAMS)
    fits = out.fits.select("cloud_id", "wire_id", "df", r("rsq", 4).alias("rsq"))
    return out.wires.join(fits, list(WIRE)).select("wire_id", "count", r("length", 4).alias("length"), "df", "rsq")


@query
def summarise_wires(spark, sf):
    w = wires(spark, sf)
    fits = fit.polyfit2(w.where("wire_id < 140"), WIRE)
    floor = lots(spark, sf).select(F.lit("events").alias("cloud_id"), F.lit(0).cast("long").alias("point_id"),
                                   (F.col("x") * 14).alias("x"), (F.col("y") * 7).alias("y"), (F.col("z") - 200).alias("z"))
    s = wire_summary(w, fits, floor, side=20.0)
    return s.select("wire_id", "count", "method", r("distance", 2).alias("distance"))


@query
def summarise_classes(spark, sf):
    s = class_summary(lots(spark, sf))
    b = rounded(s.bounds, 6, *[c for c in s.bounds.columns if c != "cloud_id"])
    return s.classes.join(b, "cloud_id")
