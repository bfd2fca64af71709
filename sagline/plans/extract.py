"""From a point cloud to modelled wires."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline import session
from sagline.operators.cluster import euclidean_clusters
from sagline.operators.fit import polyfit2
from sagline.operators.generate import densify_wire
from sagline.operators.ground import split_ground, validate_mask
from sagline.operators.merge import merge_segments
from sagline.operators.ordering import number_rows
from sagline.operators.segments import build_segments, min_cluster_size, segment_length, total_length
from sagline.operators.shape import line_candidates
from sagline.schema import Params


class Extraction(NamedTuple):
    """``wires`` (one row each), ``points`` on wires, ``fits``, ``ground``, ``densified``, ``lengths`` per cloud."""

    wires: DataFrame
    points: DataFrame
    fits: DataFrame
    ground: DataFrame
    densified: DataFrame
    lengths: DataFrame


def extract_power_lines(points: DataFrame, params: Params = Params(), by: Sequence[str] = ("cloud_id",)) -> Extraction:
    """Find and model the wires of every cloud. Wires are numbered from 0 in segment order."""
    by, p = list(by), params
    above, ground = split_ground(points, p.bins, p.bin_offset, by)
    above = validate_mask(session.cut_lineage(above.select(*by, "point_id", "x", "y", "z")))
    lines = session.cut_lineage(line_candidates(above, p.radius, p.angle, p.linearity, by))
    coarse = min_cluster_size(euclidean_clusters(lines, p.cluster_distance, by), p.min_cluster, by)
    fine = euclidean_clusters(session.cut_lineage(coarse.drop("cluster_id")), p.segment_distance, by, label="seg_id")
    fine = session.cut_lineage(fine)
    segments, fine = merge_segments(
        build_segments(fine, by), fine, p.merge_passes, by, p.merge_order,
        line=p.merge_line, curve=p.merge_curve, height=p.merge_height, seed=p.merge_seed)

    lengths = session.cut_lineage(segment_length(fine, by).where(F.col("length") >= p.min_length))
    wires = segments.join(lengths.select(*by, "seg_id", "length"), [*by, "seg_id"])
    wires = number_rows(wires, by, ["pos"], "_w").withColumn("wire_id", (F.col("_w") - 1).cast("int"))
    wires = session.cut_lineage(wires.select(*by, "wire_id", "seg_id", "label", "count", "ids", "length"))
    on_wires = session.attach(fine, wires.select(*by, "seg_id", "wire_id"), [*by, "seg_id"])
    on_wires = session.cut_lineage(on_wires.select(*by, "wire_id", "point_id", "x", "y", "z"))
    keys = [*by, "wire_id"]
    return Extraction(wires, on_wires, polyfit2(on_wires, keys, axis=p.fit_axis), ground,
                      densify_wire(on_wires, p.resolution, keys), total_length(wires, by))
