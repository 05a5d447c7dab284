"""Motion segments and datum locking against plain versions."""

import numpy as np
import pytest
from posegrid.operators import datum, windows
from pyspark.sql import functions as F


def plain_segments(rows, least, still=0.05, turn_deg=20.0):
    """rows: (t, x, y, moving) in order."""
    found = []
    for i, (_, _, _, m) in enumerate(rows):
        if found and found[-1][0] == m:
            found[-1][2] = i
        else:
            found.append([m, i, i])
    merged = []
    for m, a, b in found:
        if merged and (rows[b][0] - rows[a][0] < least or merged[-1][0] == m):
            merged[-1][2] = b
        else:
            merged.append([m, a, b])

    def heading(m, a, b):
        d = np.array(rows[b][1:3]) - np.array(rows[a][1:3])
        return np.degrees(np.arctan2(d[1], d[0])) if m and np.hypot(*d) > still else None

    h = [heading(*s) for s in merged]
    out = []
    for i, (m, a, b) in enumerate(merged):
        before, after = h[i - 1] if i else None, h[i + 1] if i + 1 < len(h) else None
        turned = None if before is None or after is None else after - before
        kind = "forward" if m else "turn" if turned is not None and abs((turned + 180) % 360 - 180) > turn_deg else "stationary"
        out.append((i + 1, kind, rows[a][0], rows[b][0], b - a + 1, h[i] if m else turned if kind == "turn" else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_motion_segments(spark, seed):
    rng = np.random.default_rng(seed)
    data = {}
    for run in range(5):
        n = int(rng.integers(1, 80))
        flags = np.repeat(rng.random(n) < 0.5, rng.integers(1, 6, n))[:n]
        place = np.cumsum(flags[:, None] * rng.normal(0, 1, (n, 2)), axis=0)
        data[run] = [(int(t), float(x), float(y), bool(m)) for t, (x, y), m in zip(np.cumsum(rng.integers(1, 4, n)), place, flags, strict=True)]
    df = spark.createDataFrame([(r, *row) for r, rows in data.items() for row in rows], "run long, t long, x double, y double, m boolean").orderBy(F.rand(3))
    got = windows.motion_segments(df, ["run"], ["t"], F.col("m"), "t", 5).orderBy("run", "segment").collect()
    want = [(r, *s) for r, rows in data.items() for s in plain_segments(rows, 5)]
    assert [tuple(g)[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g.heading is None) == (w[6] is None) and (w[6] is None or np.isclose(g.heading, w[6]))


def plain_lock(rows, baseline, excitation, speed, fixes, sigma):
    for n in range(2, len(rows) + 1):
        e, m, v = rows[:n, :3], rows[:n, 3:6], rows[:n, 6]
        if np.linalg.norm(np.diff(m, axis=0), axis=1).sum() <= baseline or (v > speed).sum() < fixes:
            continue
        de, dm = e - e.mean(0), m - m.mean(0)
        axis = np.linalg.eigh(de[:, :2].T @ de[:, :2])[1][:, 1]
        if np.ptp(de[:, :2] @ axis) <= excitation or 1 / np.sqrt((de[:, :2] ** 2).sum()) >= sigma:
            continue
        cross = dm[:, :2].T @ de[:, :2]
        yaw = np.arctan2(cross[1, 0] - cross[0, 1], cross[0, 0] + cross[1, 1])
        r = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
        return n, yaw, 1 / np.sqrt((de[:, :2] ** 2).sum()), *(m.mean(0) - r @ e.mean(0))
    return None


@pytest.mark.parametrize("batch", [10000, 13])
def test_datum_lock(spark, batch):
    rng = np.random.default_rng(2)
    data, gates = {}, (8.0, 5.0, 0.4, 6, 0.05)
    for run in range(12):
        n = int(rng.integers(1, 60))
        way = np.cumsum(rng.normal(0.3 if run % 3 else 0.0, 0.4, (n, 3)), axis=0)
        yaw = rng.uniform(-3, 3)
        turn = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
        fixes = (way - [5, 6, 7]) @ turn + rng.normal(0, 0.05, (n, 3)) + 1e4
        data[run] = np.concatenate([fixes, way, rng.random((n, 1))], axis=1)
    names = ", ".join(f"{c} double" for c in datum.COLUMNS)
    rows = [(run, i, 100 + i, *r) for run, m in data.items() for i, r in enumerate(m.tolist())] + [(0, 1000, 5, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, f"run long, n long, fix long, {names}").orderBy(F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.run: tuple(r)[1:] for r in datum.datum_lock(df, ["run"], ["n"], "fix", *gates).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {run: lock for run, m in data.items() if (lock := plain_lock(m, *gates))}
    assert set(got) == set(want) and 0 < len(want) < len(data)
    for run, (n, *rest) in want.items():
        assert got[run][:2] == (99 + n, n) and np.allclose(got[run][2:], rest, atol=1e-6)
    assert datum.datum_lock(df.filter("run < 0"), ["run"], ["n"], "fix", *gates).collect() == []


def test_projection_moves_as_its_jacobian_says(spark):
    from posegrid.functions import geometry as M

    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(-1, 1, (40, 2)), rng.uniform(0.5, 3, (40, 1))], axis=1)
    camera, lens = (400.0, 410.0, 320.0, 240.0), (0.05, -0.01, 0.002, -0.003)
    step = 1e-6
    moved = [p] + [p + s * step * np.eye(3)[a] for a in range(3) for s in (1, -1)]
    df = spark.createDataFrame([(k, i, *map(float, row)) for k, points in enumerate(moved) for i, row in enumerate(points)] + [(0, 99, 0.0, 0.0, -1.0)], "k long, i long, x double, y double, z double")
    at = tuple(F.col(c) for c in "xyz")
    u, v = M.project(at, *camera, *lens)
    rows = df.select("k", "i", u.alias("u"), v.alias("v"), M.in_image(u, v, 640, 480).alias("inside"), F.array(*M.project_jacobian(at, camera[0], camera[1], *lens)).alias("j")).collect()
    by = {(r.k, r.i): r for r in rows}
    for i in range(40):
        for a in range(3):
            plus, minus = by[1 + 2 * a, i], by[2 + 2 * a, i]
            assert np.allclose([(plus.u - minus.u) / (2 * step), (plus.v - minus.v) / (2 * step)], [by[0, i].j[a], by[0, i].j[3 + a]], rtol=1e-5, atol=1e-3)
        r = by[0, i]
        assert r.inside == (0 <= r.u < 640 and 0 <= r.v < 480)
    assert by[0, 99].u is None and not by[0, 99].inside and by[0, 99].j == [None] * 6


def test_spoof_run(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for run in (1, 2):
        ring, n, x, t = [], 0, 0.0, 0
        for i in range(200):
            t += int(rng.integers(1, 5))
            x += 2.0 * 1 + (30.0 if 60 < i < 90 else 0.0)
            speed = None if i % 11 == 0 else 0.8
            seen = next((e for e in ring if t - e[0] >= 6), None)
            reject = False
            if seen is not None and speed is not None:
                n = n + 1 if abs((x - seen[1]) / (t - seen[0]) - speed) > 1.0 else 0
                reject = n >= 3
            if not reject:
                ring = [*ring, (t, x)][-5:]
            rows.append((run, t, i, x, speed))
            want.append((run, i, n, reject))
    df = spark.createDataFrame(rows, "run long, t long, i long, x double, s double").orderBy(F.rand(2))
    got = windows.spoof_run(df, ["run"], ["t", "i"], "t", "x", "s", ["i"], 6, 1, 1.0, 3, 5).orderBy("run", "i").collect()
    assert [tuple(r) for r in got] == want
    assert {w[3] for w in want} == {True, False}
