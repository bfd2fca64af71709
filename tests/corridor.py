"""Seeded point clouds with known wires."""

from __future__ import annotations

import numpy as np
import pandas as pd


def wire(rng, x0, y0, azimuth, length, height, a, step=0.04, gaps=(), noise=0.01):
    """Points on a catenary from (x0, y0); ``gaps`` are (start, end) along it."""
    t = np.arange(0.0, length, step)
    for lo, hi in gaps:
        t = t[(t < lo) | (t > hi)]
    z = height + a * (np.cosh((t - length / 2) / a) - 1)
    xyz = np.column_stack([x0 + t * np.cos(azimuth), y0 + t * np.sin(azimuth), z])
    return xyz + rng.normal(0, noise, xyz.shape)


def corridor(seed=7, offset=(0.0, 0.0), cloud="c0", size=40.0):
    """Ground, four wires (gaps in three of them, one along Y), two poles, shrubs and stray points."""
    rng = np.random.default_rng(seed)
    parts, kinds, truth = [], [], []

    def add(xyz, kind, wire_id=None):
        parts.append(xyz)
        kinds.extend([kind] * len(xyz))
        truth.extend([wire_id] * len(xyz))

    n = 9000
    add(np.column_stack([rng.uniform(0, size, n), rng.uniform(0, size, n), rng.normal(0, 0.03, n)]), "ground")
    add(wire(rng, 2, 8, 0.0, 30, 10.0, 120, gaps=[(9, 9.8), (20, 20.6)]), "wire", 0)
    add(wire(rng, 2, 12, 0.0, 30, 10.5, 120, gaps=[(14, 15)]), "wire", 1)
    add(wire(rng, 3, 20, 0.5, 25, 12.0, 90, gaps=[(12, 12.7)]), "wire", 2)
    add(wire(rng, 36, 3, np.pi / 2, 28, 14.0, 150), "wire", 3)
    for x, y in ((1, 1), (38, 38)):
        add(np.column_stack([np.full(160, x), np.full(160, y), np.linspace(2, 10, 160)]) + rng.normal(0, 0.01, (160, 3)), "pole")
    for x, y in ((10, 30), (25, 35)):
        add(rng.normal([x, y, 5], 0.5, (400, 3)), "vegetation")
    add(np.column_stack([rng.uniform(0, size, 30), rng.uniform(0, size, 30), rng.uniform(16, 25, 30)]), "noise")
    xyz = np.concatenate(parts) + np.array([*offset, 0.0])
    out = pd.DataFrame(xyz, columns=list("xyz"))
    out.insert(0, "cloud_id", cloud)
    out.insert(1, "point_id", np.arange(len(out)))
    out["classification"] = [{"ground": 2, "wire": 8, "pole": 11, "vegetation": 3, "noise": 6}[k] for k in kinds]
    out["true_wire"] = pd.array(truth, dtype="Int32")
    return out
