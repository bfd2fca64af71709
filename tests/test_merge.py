"""Merge passes against a plain loop over segments."""

import numpy as np
import pandas as pd
import pytest

from sagline.operators import merge
from sagline.operators import segments as seg_ops
from sagline.session import cut_lineage as session_cut


def pieces(seed=0, wires=4, parts=5, clouds=2):
    """Wires in several pieces, some off by more than a gate, and loose short bits."""
    rows = []
    for c in range(clouds):
        rng = np.random.default_rng(seed + c)
        seg = 0
        for w in range(wires):
            az, y0 = rng.uniform(0, 1.2), 6.0 * w
            for k in range(parts):
                n = int(rng.integers(4, 40))
                t = np.sort(rng.uniform(6 * k, 6 * k + 5, n))
                lift = rng.choice([0.0, 0.0, 0.0, 0.15, 0.5])
                rows.append(pd.DataFrame({
                    "cloud_id": f"c{c}", "seg_id": seg, "x": t * np.cos(az) + rng.normal(0, .01, n),
                    "y": y0 + t * np.sin(az) + rng.normal(0, .01, n), "z": 10 + 0.004 * (t - 15) ** 2 + lift + rng.normal(0, .01, n)}))
                seg += 1
    out = pd.concat(rows, ignore_index=True)
    out.insert(2, "point_id", np.arange(len(out)))
    return out


def plain_pass(parts, order, line=0.5, curve=0.2, height=4.0):
    """{seed: [absorbed]} by scanning the segments one after the other."""
    gone, taken = set(), {}
    for i, a in enumerate(order):
        A = parts[a]
        if a in gone or len(A) < 10:
            continue
        mean = A.mean(axis=0)
        c = A - mean
        w, v = np.linalg.eigh(np.cov(c.T))
        e = v[:, 2] if v[1, 2] >= 0 else -v[:, 2]
        ang = np.arccos(np.clip(e[0], -1, 1))

        def turn(q):
            return (q[:, 0] - mean[0]) * np.cos(ang) + (q[:, 1] - mean[1]) * np.sin(ang), q[:, 2] - mean[2]

        u, h = turn(A)
        p = np.polyfit(u, h, 2)
        l = np.polyfit(c[:, 0], A[:, 1], 1)
        for b in order[i + 1:]:
            if b in gone:
                continue
            B = parts[b]
            bu, bh = turn(B)
            if (abs(np.mean(np.polyval(l, B[:, 0] - mean[0]) - B[:, 1])) < line and abs(mean[2] - B[:, 2].mean()) < height
                    and np.abs(np.polyval(p, bu) - bh).max() < curve):
                taken.setdefault(a, []).append(b)
                gone.add(b)
                u, h = np.concatenate([u, bu]), np.concatenate([h, bh])
                p = np.polyfit(u, h, 2)
    return taken


def plain_merge(p, passes=3, stale=True, **gates):
    """Members of each merged segment, in final order."""
    segs = [(s, g[["x", "y", "z"]].to_numpy(), {s}) for s, g in p.groupby("seg_id")]
    order = sorted(range(len(segs)), key=lambda i: (-len(segs[i][1]), i))
    for _ in range(passes):
        taken = plain_pass({i: s[1] for i, s in enumerate(segs)}, order, **gates)
        lost = {b for v in taken.values() for b in v}
        new = [(s[0], np.concatenate([s[1], *[segs[b][1] for b in taken.get(i, [])]]),
                s[2].union(*[segs[b][2] for b in taken.get(i, [])])) for i, s in enumerate(segs) if i not in lost]
        counts = [len((segs if stale else new)[i][1]) for i in range(len(new))]
        order = sorted(range(len(new)), key=lambda i: (-counts[i], i))
        segs = new
    return [segs[i] for i in order]


@pytest.mark.parametrize("scan_rows,order,passes", [(None, "stale", 3), (None, "merged", 2), (0, "stale", 1)])
def test_merge_is_the_plain_loop(spark, scan_rows, order, passes):
    p = pieces(wires=3 if scan_rows == 0 else 4)
    df = spark.createDataFrame(p).repartition(7)
    seg, points = merge.merge_segments(seg_ops.build_segments(df), df, passes, order=order, scan_rows=scan_rows)
    seg, points = seg.toPandas(), points.toPandas()
    members = p.merge(points[["point_id", "seg_id"]], on="point_id", suffixes=("", "_new"))
    some = 0
    for c, g in p.groupby("cloud_id"):
        want = plain_merge(g, passes, stale=order == "stale")
        mine = seg[seg.cloud_id == c].sort_values("ord")
        assert mine.seg_id.tolist() == [w[0] for w in want]
        assert mine["count"].tolist() == [len(w[1]) for w in want]
        for s, _, ids in want:
            assert set(members[(members.cloud_id == c) & (members.seg_id_new == s)].seg_id) == ids
            some += len(ids) > 1
    assert some > 2


def test_rounds_and_scan_agree_on_a_chain(spark):
    p = pieces(seed=40, wires=1, parts=9, clouds=1)
    df = spark.createDataFrame(p)
    seg = seg_ops.rank_segments(seg_ops.build_segments(df))
    a = merge.find_merges(seg, df, curve=0.3).toPandas()
    b = merge.find_merges(seg, df, curve=0.3, scan_rows=0).toPandas()
    assert len(a) > 2 and set(zip(a.into, a.seg_id)) == set(zip(b.into, b.seg_id))


def rounds_of(monkeypatch):
    """Counts the rounds of scans by depth."""
    made = []
    plain = merge._ready_seeds
    monkeypatch.setattr(merge, "_ready_seeds", lambda *a: made.append(1) or plain(*a))
    return made


@pytest.mark.parametrize("parts", [12])
def test_a_wire_in_many_pieces_needs_few_rounds(spark, monkeypatch, parts):
    """The first seed takes all other pieces in one round; only the graph, not a seed's candidates, is too large for a task."""
    t = np.linspace(0, 5, 20)
    rows = [pd.DataFrame({"cloud_id": "c", "seg_id": k, "x": t[:20 - (k > 0)] + 6 * k, "y": 0.0, "z": 10 + .0004 * (t[:20 - (k > 0)] + 6 * k) ** 2})
            for k in range(parts)]
    p = pd.concat(rows, ignore_index=True).assign(point_id=lambda d: range(len(d)))
    df = spark.createDataFrame(p)
    seg = seg_ops.rank_segments(seg_ops.build_segments(df))
    made = rounds_of(monkeypatch)
    got = merge.find_merges(seg, df, scan_rows=len(p) - 1).collect()
    assert {(r["into"], r["seg_id"]) for r in got} == {(0, k) for k in range(1, parts)} and len(got) == parts - 1
    assert len(made) == 1


def test_every_limit_gives_the_plain_loop(spark, monkeypatch):
    """Whole clouds, pieces of the graph, whole seeds and single steps, and mixtures of them."""
    p = pieces(seed=11, wires=2, parts=4, clouds=1)
    df = spark.createDataFrame(p).repartition(5)
    seg = session_cut(seg_ops.rank_segments(seg_ops.build_segments(df)))
    made, want = rounds_of(monkeypatch), None
    for limit in (None, 60):
        got = sorted((r["cloud_id"], r["into"], r["seg_id"]) for r in merge.find_merges(seg, df, scan_rows=limit).collect())
        want = got if want is None else want
        assert got == want and len(got) > 1
    assert made


@pytest.mark.parametrize("far", [10.0001, 10.5])
def test_degenerate_seed_is_one_rule(spark, far):
    """A seed whose places are three only by rounding takes the same at every size."""
    seed = [(x, 0.0, 0.0) for x in [0.0] * 6 + [10.0] * 3 + [far] * 3]
    rows = [("c", 0, i, *p) for i, p in enumerate(seed)] + [("c", 1, 100 + i, 10.00002 + 0.00001 * i, 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "cloud_id string, seg_id long, point_id long, x double, y double, z double")
    seg = seg_ops.rank_segments(seg_ops.build_segments(df))
    found = [sorted(map(tuple, merge.find_merges(seg, df, scan_rows=n).collect())) for n in (None, 20, 0)]
    assert found[0] == found[1] == found[2]


def test_gates_are_brute_force(spark):
    p = pieces(seed=3, wires=6, parts=6)
    df = spark.createDataFrame(p)
    seg = merge.segment_frames(df).join(seg_ops.rank_segments(seg_ops.build_segments(df)), ["cloud_id", "seg_id"])
    got = merge.merge_gate_join(seg, 2.5, 1.0).toPandas()
    s = seg.toPandas()
    for c, g in s.groupby("cloud_id"):
        want = {(a.seg_id, b.seg_id) for a in g.itertuples() for b in g.itertuples()
                if a.ord < b.ord and a.n >= 10 and abs(a.my + a.slope * (b.mx - a.mx) - b.my) < 2.5 and abs(a.mz - b.mz) < 1.0}
        mine = got[got.cloud_id == c]
        assert len(mine) == len(want) and set(zip(mine.a, mine.b)) == want


def test_stale_order_uses_counts_before_the_pass(spark):
    before = spark.createDataFrame([("c", 0, 1, 5), ("c", 1, 2, 50), ("c", 2, 3, 20), ("c", 3, 4, 70)],
                                   "cloud_id string, seg_id long, pos long, count long")
    after = before.where("seg_id <> 0").selectExpr("cloud_id", "seg_id", "pos", "count + 100 * (3 - seg_id) as count")
    stale = seg_ops.rerank_after_merge(before, after).orderBy("ord").collect()
    merged = seg_ops.rerank_after_merge(before, after, order="merged").orderBy("ord").collect()
    assert [r.seg_id for r in stale] == [2, 3, 1]
    assert [r.seg_id for r in merged] == [1, 2, 3]


def test_pair_test_accepts_the_same_wire(spark):
    t = np.linspace(0, 60, 600)
    z = 200 * np.cosh((t - 30) / 200)
    mid = (t > 20) & (t < 40)
    seg = np.where(t < 20, 0, np.where(mid, 1, 2))
    p = pd.DataFrame({"cloud_id": "c", "seg_id": seg, "point_id": range(600), "x": t * 0.8, "y": t * 0.6, "z": z})
    off = p[p.seg_id == 2].assign(seg_id=3, z=lambda d: d.z + 0.3)
    df = spark.createDataFrame(pd.concat([p, off]))
    pairs = spark.createDataFrame([("c", 1, 0), ("c", 1, 2), ("c", 1, 3)], "cloud_id string, a long, b long")
    got = merge.pair_merge_test(pairs, df).toPandas().set_index("b")
    assert (got["merge"][[0, 2]] == 1).all() and got["merge"][3] == 0


def crossing(segments=60):
    """Segments that nearly all pass each other's gates, and of which a curve takes about half."""
    rng = np.random.default_rng(5)
    rows = [pd.DataFrame({"cloud_id": "c", "seg_id": s, "x": np.sort(rng.uniform(0, 50, 12)), "y": rng.normal(0, .1, 12),
                          "z": 10 + rng.normal(0, 1, 12) + (rng.random(12) < .06) * 6}) for s in range(segments)]
    return pd.concat(rows, ignore_index=True).assign(point_id=lambda d: range(len(d)))


def test_crowded_cloud_writes_no_graph(spark, monkeypatch):
    """A cloud of one task, and a larger one in runs of its order, take what the plain loop takes without writing the gates."""
    p = crossing()
    df = spark.createDataFrame(p).repartition(4)
    seg = session_cut(seg_ops.rank_segments(seg_ops.build_segments(df)))
    gates = {"line": 0.5, "curve": 5.0, "height": 4.0}
    parts = {s: g[["x", "y", "z"]].to_numpy() for s, g in p.groupby("seg_id")}
    want = {(a, b) for a, v in plain_pass(parts, sorted(parts), **gates).items() for b in v}
    assert len({a for a, _ in want}) > 2 and len(want) > 20
    monkeypatch.setattr(merge, "GATE_ROWS", 100)
    monkeypatch.setattr(merge, "merge_gate_join", None)
    for limit in (None, 100):
        got = [(r["into"], r["seg_id"]) for r in merge.find_merges(seg, df, scan_rows=limit, **gates).collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_gate_at_its_limit_is_closed(spark):
    """4.1 - 3.1 and 0.35 - 0.3 are below 1 and 0.05 by rounding only."""
    rows = [("c", 0, 1, 20, 0.0, 0.3, 3.1, 0.0), ("c", 1, 2, 20, 1.0, 0.3, 4.1, 0.0), ("c", 2, 3, 20, 2.0, 0.35, 3.1, 0.0),
            ("c", 3, 4, 20, 3.0, 0.349, 4.099, 0.0)]
    assert 4.1 - 3.1 < 1.0 and 0.35 - 0.3 < 0.05
    seg = spark.createDataFrame(rows, "cloud_id string, seg_id long, ord long, n long, mx double, my double, mz double, slope double")
    got = {(r["a"], r["b"]) for r in merge.merge_gate_join(seg, 0.05, 1.0).collect() if r["a"] == 0}
    assert got == {(0, 3)}


def test_dense_cloud_of_few_segments_goes_without_rounds(spark, monkeypatch):
    """Nearly all segments are candidates of each other and few are taken, so rounds would settle one seed each."""
    rng, n = np.random.default_rng(5), 250
    t = np.linspace(0, 5, 4)
    rows = [pd.DataFrame({"cloud_id": "c", "seg_id": k, "x": t + rng.uniform(0, 50), "y": 0.0, "z": 10 + .01 * t ** 2 + rng.uniform(0, 3)}) for k in range(n)]
    p = pd.concat(rows, ignore_index=True).assign(point_id=lambda d: range(len(d)))
    df = spark.createDataFrame(p)
    seg = session_cut(seg_ops.rank_segments(seg_ops.build_segments(df)))
    want = sorted(map(tuple, merge.find_merges(seg, df, seed=3, curve=0.05).collect()))

    def no_rounds(*_):
        raise AssertionError("rounds over a dense graph")

    monkeypatch.setattr(merge, "_ready_seeds", no_rounds)
    assert sorted(map(tuple, merge.find_merges(seg, df, seed=3, curve=0.05, scan_rows=400).collect())) == want and 2 < len(want) < n // 2


def test_large_segments_stay_out_of_tasks(spark, monkeypatch):
    """Segments with more points than a task scans, taken or taking at any place of the order, give the plain loop."""
    rng, sizes = np.random.default_rng(9), [12] * 30 + [150, 120, 200, 130]
    rows = [pd.DataFrame({"cloud_id": c, "seg_id": s, "x": np.sort(rng.uniform(0, 50, n)), "y": rng.normal(0, .02, n), "z": 10 + rng.normal(0, .3, n)
                          + (rng.random(n) < (.06 if n < 100 else .0)) * 6 + (s == 33) * 3}) for c in ("c", "d") for s, n in enumerate(sizes)]
    p = pd.concat(rows, ignore_index=True).assign(point_id=lambda d: range(len(d)))
    df = spark.createDataFrame(p).repartition(4)
    order = rng.permutation(len(sizes))
    seg = spark.createDataFrame([(c, int(s), int(o)) for c in ("c", "d") for o, s in enumerate(order)], "cloud_id string, seg_id long, ord long")
    gates, limit = {"line": 0.5, "curve": 5.0, "height": 4.0}, 100
    want = set()
    for c, g in p.groupby("cloud_id"):
        parts = {s: q[["x", "y", "z"]].to_numpy() for s, q in g.groupby("seg_id")}
        want |= {(c, a, b) for a, v in plain_pass(parts, order, **gates).items() for b in v}
    assert {sizes[b] > limit for _, _, b in want} == {True, False} and len({a for _, a, _ in want}) > 1
    monkeypatch.setattr(merge, "GATE_ROWS", 100)
    plain = merge._scan_run

    def bounded(points, *rest):
        assert len(points) <= 2 * limit
        return plain(points, *rest)

    monkeypatch.setattr(merge, "_scan_run", bounded)
    got = [tuple(r) for r in merge.find_merges(seg, df, scan_rows=limit, **gates).select("cloud_id", "into", "seg_id").collect()]
    assert len(got) == len(want) and set(got) == want
