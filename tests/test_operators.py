"""Invariants and brute-force versions of operators that SQL doesn't express, and edge cases of those it does."""

import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import pytest
from posegrid import config
from posegrid.functions import geometry, manifold
from posegrid.operators import aggregations, folds, graph, joins, meshing, registration, windows
from posegrid.sources import packet_log
from posegrid.streaming import align
from pyspark.sql import functions as F


def poses(rng, n, spread=1.0):
    return manifold.exp(np.concatenate([rng.normal(0, spread, (n, 3)), rng.normal(0, 0.5, (n, 3))], axis=1))


# --- manifold


def test_exp_log_round_trip():
    rng = np.random.default_rng(1)
    xi = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(200, 3)) * np.repeat([1e-7, 1e-4, 0.1, 0.9], 50)[:, None]], axis=1)
    assert np.allclose(manifold.log(manifold.exp(xi)), xi, atol=1e-7)


def test_boxminus_undoes_boxplus_and_interpolation_ends():
    rng = np.random.default_rng(2)
    a, b, xi = poses(rng, 50), poses(rng, 50), rng.normal(0, 0.3, (50, 6))
    assert np.allclose(manifold.boxminus(manifold.boxplus(a, xi), a), xi, atol=1e-9)
    assert np.allclose(manifold.log(manifold.compose(manifold.inverse(manifold.interpolate(a, b, np.full((50, 1), 2.0))), b)), 0, atol=1e-8)


def test_adjoint_moves_tangents():
    rng = np.random.default_rng(3)
    t, xi = poses(rng, 20), rng.normal(0, 0.2, (20, 6))
    left = manifold.compose(manifold.exp(np.einsum("nij,nj->ni", manifold.adjoint(t), xi)), t)
    assert np.allclose(manifold.log(manifold.compose(manifold.inverse(left), manifold.boxplus(t, xi))), 0, atol=1e-9)


def test_quaternion_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    q = poses(rng, 30)[:, :4]
    df = spark.createDataFrame([tuple(map(float, r)) for r in q], "x double, y double, z double, w double")
    c = tuple(F.col(n) for n in "xyzw")
    got = np.array([list(r) for r in df.select(*[v.alias(f"q{i}") for i, v in enumerate(geometry.mat_to_quat(geometry.quat_to_mat(c)))], *[v.alias(f"r{i}") for i, v in enumerate(geometry.rotate(c, (F.lit(1.0), F.lit(2.0), F.lit(3.0))))]).collect()])
    assert np.allclose(np.abs((got[:, :4] * q).sum(1)), 1) and np.allclose(got[:, 4:], manifold.turn(q, np.tile([1.0, 2.0, 3.0], (30, 1))))


# --- joins


def test_asof_with_and_without_buckets(spark):
    rng = random.Random(5)
    left = [(rng.randrange(3), rng.randrange(200)) for _ in range(150)]
    right = [(rng.randrange(3), s, i) for i, s in enumerate(rng.sample(range(200), 40))]
    ldf = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(left)], "k int, s long, n long")
    rdf = spark.createDataFrame(right, "k int, s long, v long")
    for width, strict in itertools.product((None, 13), (False, True)):
        back = {r["n"]: r["v"] for r in joins.asof_backward(ldf, rdf, "s", ["v"], ["k"], strict, width).collect()}
        ahead = {r["n"]: r["v"] for r in joins.asof_forward(ldf, rdf, "s", ["v"], ["k"], strict, width).collect()}
        for n, (k, s) in enumerate(left):
            before = [(t, v) for j, t, v in right if j == k and (t < s if strict else t <= s)]
            after = [(t, v) for j, t, v in right if j == k and (t > s if strict else t >= s)]
            assert back[n] == (max(before)[1] if before else None) and ahead[n] == (min(after)[1] if after else None)


def test_revisits_let_missing_places_pass(spark):
    rows = [(1, n, n * 10, *(((float(n % 3), 0.0)) if n != 4 else (None, None))) for n in range(1, 8)]
    got = {tuple(r) for r in joins.revisit_candidates(spark.createDataFrame(rows, "run int, n long, t long, x double, y double"), 2, 20, 0.5, ["run"]).select("q", "id").collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] - b[1] >= 2 and a[2] - b[2] >= 20 and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 0.5)}
    assert got == want


def test_grid_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    q, t = rng.uniform(-3, 3, (80, 3)), rng.uniform(-3, 3, (200, 3))
    frame = lambda p, n: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], f"{n} long, x double, y double, z double")
    got = {r["q"]: (r["id"], r["d2"]) for r in joins.voxel_nn(frame(q, "q"), frame(t, "id"), 1.0, 0.9).collect()}
    d = ((q[:, None] - t[None]) ** 2).sum(2)
    assert set(got) == {i for i in range(80) if d[i].min() <= 0.81}
    assert all(got[i][0] == d[i].argmin() for i in got)
    near = {(r["q"], r["id"]) for r in joins.voxel_radius(frame(q, "q"), frame(t, "id"), 1.0, 1.0).collect()}
    assert near == {(int(i), int(j)) for i, j in np.argwhere(d <= 1.0)}


# --- folds


def test_streamed_fold(spark):
    rng = random.Random(7)
    rows = [(i % 4, i, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, n long, v double")
    step = lambda s, r: {"s": (0.0 if s["s"] > 2 else s["s"]) + r["v"]}
    got = {(r["k"], r["n"]): r["s"] for r in folds.streamed_fold(df, ["k"], ["n"], {"s": 0.0}, step, ["n"], "s double").collect()}
    state = {}
    for k, n, v in rows:
        state[k] = (0.0 if state.get(k, 0.0) > 2 else state.get(k, 0.0)) + v
        assert got[k, n] == state[k]


def test_one_key_is_folded_in_linear_time(spark):
    """Selections over one long stream pass through it once."""
    took = []
    for n in (20_000, 20_000, 80_000):
        df = spark.range(n).select(F.lit("a").alias("run"), (F.col("id") * 7).alias("t"), F.col("id").alias("event_id"))
        start = time.perf_counter()
        assert windows.rate_limit(df, ["run"], "t", 20).count() == -(-n // 3)
        took.append(time.perf_counter() - start)
    assert took[2] < 8 * took[1] + 2


def test_exponential_average_over_buckets(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, None if rng.random() < 0.2 or 40 < i < 70 else rng.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, n long, v double")
    got = {(r["k"], r["n"]): r["e"] for r in folds.ewma(df, ["k"], ["n"], F.col("v"), 0.1, F.floor(F.col("n") / 13), ["n"], "e").collect()}
    last = {r["k"]: r["e"] for r in folds.last_ewma(df, ["k"], ["n"], F.col("v"), 0.1, F.floor(F.col("n") / 13), "e").collect()}
    state = {}
    for k, n, v in rows:
        if v is not None:
            state[k] = v if state.get(k) is None else state[k] + 0.1 * (v - state[k])
        assert got[k, n] == (None if k not in state else pytest.approx(state[k]))
    assert last == {k: pytest.approx(v) for k, v in state.items()} and len(got) == 240


@pytest.mark.parametrize("accuracy", [1000, 20])
def test_exact_medians(spark, accuracy):
    rng = random.Random(10)
    rows = [(k, round(rng.random(), 2 if k % 2 else 6)) for k, n in enumerate((1, 2, 7, 500, 1001)) for _ in range(n)] + [(9, None), (3, None)] + [(7, 1.0)] * 300
    got = {r["k"]: r["median"] for r in aggregations.medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", accuracy).collect()}
    assert got == {k: pytest.approx(float(np.median([v for j, v in rows if j == k and v is not None]))) for k in (0, 1, 2, 3, 4, 7)}


def test_quantiles_of_large_and_small_keys(spark, monkeypatch):
    """Keys above and below the limit agree with numpy; small ones never go through approximate percentiles."""
    rng = random.Random(12)
    rows = [(k, rng.choice([round(rng.random(), 1), rng.random()])) for k, n in enumerate((1, 2, 900, 1000, 1001, 3000)) for _ in range(n)]
    df, real, seen = spark.createDataFrame(rows, "k int, v double"), aggregations._bracketed, []
    monkeypatch.setattr(aggregations, "_bracketed", lambda r, keys, value, share, name, accuracy: seen.extend(x["k"] for x in r.select("k").distinct().collect()) or real(r, keys, value, share, name, 200))
    for share in (0.5, 0.95):
        got = {r["k"]: r["m"] for r in aggregations.quantiles(df, ["k"], "v", share, "m", 1).collect()}
        assert got == {k: pytest.approx(float(np.quantile([v for j, v in rows if j == k], share))) for k in range(6)}
    assert sorted(set(seen)) == [4, 5]


def test_spaced_insertion(spark):
    rng = random.Random(11)
    rows = [(i, 10 * rng.random(), 10 * rng.random(), 10 * rng.random()) for i in range(400)]
    kept = {}
    for i, *p in rows:
        own = kept.setdefault(tuple(math.floor(a / 5) for a in p), [])
        if len(own) < 4 and all(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) >= 25 / 4 for _, q in own):
            own.append((i, p))
    got = aggregations.voxel_insert_spaced(spark.createDataFrame(rows, "idx long, x double, y double, z double"), 5.0, 4, ["idx"]).collect()
    assert {r["idx"] for r in got} == {i for own in kept.values() for i, _ in own}


def test_operators_on_empty_tables(spark):
    p = spark.createDataFrame([], "run int, t long, kf_id long, x double, y double")
    assert windows.keyframe_select(p, ["run"], ["t", "kf_id"], 1.0, 10).count() == 0
    assert windows.sparse_profile(p, ["run"], ["t", "kf_id"], 4).count() == 0
    assert windows.rate_limit(p.withColumnRenamed("kf_id", "event_id"), ["run"], "t", 0).count() == 0


# --- registration


def test_icp_recovers_a_motion():
    rng = np.random.default_rng(8)
    cloud = rng.uniform(0, 6, (600, 3))
    motion = manifold.exp(np.array([[0.06, -0.05, 0.04, 0.01, -0.012, 0.015]]))
    moved = manifold.turn(np.tile(manifold.inverse(motion)[:, :4], (600, 1)), cloud) + manifold.inverse(motion)[:, 4:]
    got = registration.icp(moved, registration.VoxelMap(cloud, 1.0), 0.8, eps=1e-9)
    assert got["converged"] and np.allclose(manifold.log(manifold.compose(manifold.inverse(got["pose"][None]), motion)), 0, atol=1e-6)
    assert not registration.icp(moved[:3], registration.VoxelMap(cloud, 1.0), 0.8)["converged"]


def test_normal_equations_are_the_jacobian():
    rng = np.random.default_rng(9)
    p, r = rng.normal(size=(50, 3)), rng.normal(size=(50, 3))
    h, b = registration.normal_equations(p, r)
    hat = np.array([[[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]] for v in p])
    j = np.concatenate([np.tile(np.eye(3), (50, 1, 1)), -hat], axis=2)
    assert np.allclose(h, np.einsum("nij,nik->jk", j, j) / 50) and np.allclose(b, np.einsum("nij,ni->j", j, r) / 50)


# --- graphs


def chain_of(rng, n):
    true = [poses(rng, 1)[0]]
    for _ in range(n - 1):
        true.append(manifold.boxplus(true[-1][None], np.concatenate([[1.0, 0, 0], rng.normal(0, 0.05, 3)])[None])[0])
    true = np.stack(true)
    return true, between(true, [(i, i + 1) for i in range(n - 1)])


def between(true, pairs, variance=1e-4):
    """Exact edges between the given poses."""
    a, b = np.array(pairs).T
    return a, b, manifold.compose(manifold.inverse(true[a]), true[b]), np.full(len(a), variance)


def joined(*edges):
    return tuple(np.concatenate(x) for x in zip(*edges, strict=True))


def test_exact_measurements_leave_poses_alone():
    true, edges = chain_of(np.random.default_rng(10), 60)
    assert np.abs(graph.solve(true, edges) - true).max() < 1e-9


def test_optimiser_recovers_from_drift():
    rng = np.random.default_rng(11)
    true, edges = chain_of(rng, 20)
    start = manifold.boxplus(true, np.concatenate([np.zeros((1, 6)), rng.normal(0, 0.05, (19, 6))]))
    assert np.abs(manifold.boxminus(graph.solve(start, joined(edges, between(true, [(0, 10), (3, 18), (0, 19)])), 30), true)).max() < 1e-7


def dense(n, edges, diagonal, off):
    h = np.zeros((6 * n, 6 * n))
    for k in range(n):
        h[6 * k : 6 * k + 6, 6 * k : 6 * k + 6] = diagonal[k]
    for i, j, m in zip(*edges[:2], off, strict=True):
        h[6 * i : 6 * i + 6, 6 * j : 6 * j + 6] += m
        h[6 * j : 6 * j + 6, 6 * i : 6 * i + 6] += m.T
    return h


def test_elimination_against_dense_algebra():
    rng = np.random.default_rng(16)
    for n in (1, 2, 7, 40):
        true, edges = chain_of(rng, n) if n > 1 else (poses(rng, 1), (np.zeros(0, int), np.zeros(0, int), np.zeros((0, 7)), np.zeros(0)))
        if n > 6:
            edges = joined(edges, between(true, [(0, n - 1), (n - 2, 1), (2, 5), (2, 5), *[(int(i), int(j)) for i, j in rng.integers(0, n, (n // 4, 2)) if i != j]]))
        start = manifold.boxplus(true, rng.normal(0, 0.1, (n, 6)))
        diagonal, off, g = graph.assemble(n, edges, rng.uniform(0.1, 1, len(edges[0])), *graph.residuals(start, edges))
        diagonal += 3.0 * np.eye(6)
        system = graph.Elimination(n, *edges[:2])
        system.factor(diagonal, *edges[:2], off)
        h = dense(n, edges, diagonal, off)
        assert np.allclose(system.solve(g).ravel(), np.linalg.solve(h, g.ravel()), rtol=1e-6)
        cov = np.linalg.inv(h)
        assert np.allclose(system.covariances(), [cov[6 * k : 6 * k + 6, 6 * k : 6 * k + 6] for k in range(n)], rtol=1e-6, atol=1e-12)


def test_a_long_run_stays_sparse():
    """As many poses as the longest recorded run: a dense system would have 34,266 squared entries."""
    rng = np.random.default_rng(17)
    true, edges = chain_of(rng, 5711)
    edges = joined(edges, between(true, [(int(i), int(i + 900 + 7 * k)) for k, i in enumerate(rng.integers(0, 4000, 60))]))
    start = manifold.boxplus(true, np.concatenate([np.zeros((1, 6)), rng.normal(0, 0.01, (5710, 6))]))
    began = time.perf_counter()
    tracemalloc.start()
    got = graph.solve(start, edges, 6)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert np.abs(manifold.boxminus(got, true)).max() < 1e-5 and time.perf_counter() - began < 120


def test_consolidation_rejects_wrong_loops():
    rng = np.random.default_rng(12)
    true, edges = chain_of(rng, 15)
    good = between(true, [(0, 7), (2, 12), (1, 14)])
    a, b, rel, variance = between(true, [(0, 7), (2, 12)])
    bad = (a, b, manifold.boxplus(rel, np.array([[4.0, -3, 1, 0.2, 0, 0.3]] * 2)), variance)
    w, _ = graph.gnc_weights(true, edges, joined(good, bad), 16.8119)
    assert (w[:3] > 0.9).all() and (w[3:] < 0.1).all()


def cycles(true, a, b, variances, step):
    """Rows for cycle_distance: loops a and b as (from, to, poses)."""
    m = manifold.adjoint(true)
    world = np.cumsum(np.concatenate([np.zeros((1, 6, 6)), (m @ m.transpose(0, 2, 1) * step)[1:]]), axis=0).reshape(len(true), 36)
    facts = np.concatenate([true, world], axis=1)
    n = len(a[2])
    ends = np.concatenate([facts[[a[0], a[1], b[0], b[1]]].ravel()])
    return np.concatenate([a[2], b[2], np.tile(variances, (n, 1)), np.tile(ends, (n, 1))], axis=1)


def test_cycles_have_the_predicted_spread():
    """Noise drawn on both loops and the chain: the distance is chi-squared with six degrees of freedom."""
    rng = np.random.default_rng(771)
    true, (_, _, rel, _) = chain_of(rng, 14)
    exact = lambda i, j: manifold.compose(manifold.inverse(true[i : i + 1]), true[j : j + 1])
    draws, got = 1500, []
    for a, b in (((1, 9), (3, 12)), ((9, 1), (3, 12)), ((2, 8), (11, 4))):
        x = manifold.boxplus(np.tile(exact(*a), (draws, 1)), rng.normal(0, 0.02, (draws, 6)))
        y = manifold.boxplus(np.tile(exact(*b), (draws, 1)), rng.normal(0, 0.01, (draws, 6)))
        for k in range(0, draws, 5):
            steps = manifold.boxplus(rel, rng.normal(0, 0.005, (len(rel), 6)))
            noisy = [true[:1]]
            for one in steps:
                noisy.append(manifold.compose(noisy[-1], one[None]))
            row = cycles(np.concatenate(noisy), (*a, x[k : k + 1]), (*b, y[k : k + 1]), [4e-4, 1e-4], 2.5e-5)
            got.append(graph.cycle_distance(row)[0, 0])
    assert abs(np.mean(got) - 6) < 0.5 and 0.02 < np.mean(np.array(got) > 12.59) < 0.09


def test_consistency_of_loops(spark):
    rng = np.random.default_rng(13)
    true, _ = chain_of(rng, 12)
    chain = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(true)], "run long, id long, " + ", ".join(f"{c} double" for c in graph.POSE))
    rel = lambda i, j: manifold.compose(manifold.inverse(true[i : i + 1]), true[j : j + 1])[0]
    rows = [(1, 0, 0, 8, rel(0, 8)), (1, 1, 2, 10, rel(2, 10)), (1, 2, 2, 10, manifold.boxplus(rel(2, 10)[None], np.array([[1.0, 0, 0, 0, 0, 0.1]]))[0]), (1, 3, 2, 99, rel(2, 10)), (2, 4, 0, 8, rel(0, 8))]
    loops = spark.createDataFrame([(r, n, i, j, *map(float, p), 1e-4) for r, n, i, j, p in rows], "run long, loop long, from_id long, to_id long, " + ", ".join(f"{c} double" for c in graph.POSE) + ", variance double")
    got = {(r["a"], r["b"]): r["d2"] for r in graph.pcm_pairs(loops, chain, 1e-4).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)} and got[0, 1] < 1e-9 and got[0, 2] > 100
    assert graph.pcm_clique(loops.filter("run = 1 and loop < 3").select("run", "loop"), graph.pcm_pairs(loops, chain, 1e-4), 16.8119).orderBy("loop").collect() == [(1, 0), (1, 1)]


def test_max_clique_against_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        n = rng.randrange(1, 9)
        near = np.zeros((n, n), bool)
        for i, j in itertools.combinations(range(n), 2):
            near[i, j] = near[j, i] = rng.random() < 0.6
        best = max((c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(near[a, b] for a, b in itertools.combinations(c, 2))), key=lambda c: (len(c), [-x for x in c]))
        assert graph.max_clique(near) == list(best)


def test_max_clique_is_exact_in_graphs_of_any_size():
    # a vertex that many are near to belongs to none of the larger sets
    near = np.zeros((200, 200), bool)
    near[0, 1:150] = near[1:150, 0] = True
    for at in (160, 170):
        near[at : at + 5, at : at + 5] = ~np.eye(5, dtype=bool)
    assert graph.max_clique(near) == [160, 161, 162, 163, 164]
    # all sets of one of each three: as many of them as no budget of steps holds, and one longer than calls may nest
    assert graph.max_clique(np.arange(90)[:, None] // 3 != np.arange(90) // 3) == list(range(0, 90, 3))
    assert graph.max_clique(~np.eye(1200, dtype=bool)) == list(range(1200))


def test_decisions_on_loops(spark):
    """Run 1 has a set of three, run 2 single loops, run 3 a set of two which agrees with a fourth loop in part."""
    pairs = [(1, 0, 1, 1.0), (1, 0, 2, 2.0), (1, 1, 2, 3.0), (1, 0, 3, 99.0), (1, 2, 3, 50.0), (1, 0, 5, 99.0), (1, 4, 5, 1.0), (2, 0, 1, 99.0), (3, 0, 1, 1.0), (3, 0, 2, 50.0), (3, 1, 2, 2.0)]
    loops = [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False), (1, 4, False), (1, 5, True), (2, 0, False), (2, 1, False), (3, 0, False), (3, 1, True), (3, 2, False)]
    got = graph.pcm_decide(spark.createDataFrame(loops, "run long, loop long, in_graph boolean"), spark.createDataFrame(pairs, "run long, a long, b long, d2 double"), 16.8119)
    assert {(r["run"], r["loop"]): r["decision"] for r in got.collect()} == {
        (1, 0): "keep", (1, 1): "admit", (1, 2): "admit", (1, 3): "reject", (1, 4): "wait", (1, 5): "evict", (2, 0): "admit", (2, 1): "wait", (3, 0): "admit", (3, 1): "keep", (3, 2): "wait",
    }


def test_covariance_order_is_its_own_inverse(spark):
    row = spark.createDataFrame([([float(i) for i in range(36)],)], "c array<double>")
    once = row.select(graph.cov_reorder(F.col("c")).alias("c"))
    assert once.first()["c"][0] == 21.0 and once.select(graph.cov_reorder(F.col("c")).alias("c")).first()["c"] == [float(i) for i in range(36)]


# --- meshes


def test_mesh_is_closed(spark):
    n = range(-4, 5)
    field = [(x, y, z, float(np.sqrt(x * x + y * y + z * z)) - 2.3) for x in n for y in n for z in n]
    tris = meshing.marching_tetrahedra(spark.createDataFrame(field, "cx long, cy long, cz long, value double"), 1.0).toPandas()
    edges: dict = {}
    for r in tris.round(6).itertuples():
        v = [(r.px, r.py, r.pz), (r.qx, r.qy, r.qz), (r.rx, r.ry, r.rz)]
        for a, b in ((0, 1), (1, 2), (2, 0)):
            if v[a] != v[b]:
                edges[frozenset((v[a], v[b]))] = edges.get(frozenset((v[a], v[b])), 0) + 1
    assert len(tris) > 100 and set(edges.values()) == {2}
    assert np.allclose(np.linalg.norm(tris[["px", "py", "pz"]] - 0.5, axis=1), 2.3, atol=0.15)


# --- codecs and settings


def test_packet_log_round_trip_and_corruption(spark, tmp_path):
    spark.dataSource.register(packet_log.PacketLog)
    rows = [("keyframe", i, 10**18 + i, 0.1 * i, -0.0, 1e-300, 0.0, 0.0, 0.0, 1.0) for i in range(40)]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, packet_log.SCHEMA).repartition(3).write.format("packetlog").mode("append").save(path)
    assert sorted(map(tuple, spark.read.format("packetlog").load(path).collect()), key=lambda r: r[1]) == rows
    import io

    raw = b"".join(packet_log.encode(dict(zip([c.split()[0] for c in packet_log.SCHEMA.split(", ")], r, strict=True)) for r in rows))
    assert list(packet_log.decode(io.BytesIO(raw))) == rows
    for broken in (b"x" + raw[1:], raw[:5], raw[:-1], raw[: packet_log.HEADER.size + 2], raw + b"\x09\x00\x00\x00\x00"):
        with pytest.raises(packet_log.PacketLogError):
            list(packet_log.decode(io.BytesIO(broken)))


@pytest.mark.parametrize("bad", ['{"nope": {}}', '{"frontend": {"voxel_edge": -1}}', '{"preprocess": {"voxel_mode": "none"}}', '{"frontend": {"max_iterations": "9"}}', '{"preprocess": {"blind": 500}}', '{"align": {"reorder_ms": 900}}'])
def test_bad_settings_are_refused(bad):
    with pytest.raises(config.ConfigError):
        config.load(bad)


def test_defaults_survive():
    cfg = config.load('{"frontend": {"keyframe_distance": 2}}')
    assert cfg.frontend.keyframe_distance == 2.0 and cfg.frontend.max_iterations == 100 and cfg.place == config.Place()


# --- alignment of streams


def test_alignment_state_against_brute_force():
    rules = align.Rules(100, 20, 150, (("imu", 10**6), ("camera", 100), ("gnss", 100), ("lidar", 100)))
    rng = random.Random(15)
    sweeps = [(1000 + 100 * i, "lidar", i) for i in range(12)]
    imu = [(s, "imu", 100 + s) for s in range(900, 2400, 7)]
    other = [(rng.randrange(950, 2300), m, 5000 + i) for i, m in enumerate(["camera", "gnss"] * 15)]
    feed = sorted(sweeps + imu + other)
    state, out = align.empty(), []
    for s, m, e in feed:
        align.push(state, m, s, e, rules)
        out += align.close(state, rules, 1)
    out += align.close(state, rules, 1, final=True)
    assert [r[1] for r in out] == list(range(12))
    for (begin, _, sweep), r in zip(sweeps, out, strict=True):
        lower = begin if sweep == 0 else min(begin, sweeps[sweep - 1][0] + 100)
        inside = [s for s, _, _ in imu if lower < s <= begin + 100]
        last = max(s for s, _, _ in imu if s <= begin)
        assert r[2] == len(inside) + (last <= lower) and r[3] == (last if last <= lower else None)


def test_late_samples_are_dropped_and_silence_is_waited_out():
    rules = align.Rules(100, 20, 150)
    state = align.empty()
    for s in (1000, 1200, 1100):
        align.push(state, "imu", s, s, rules)
    assert [s for s, _ in state["staged"]["imu"]] == [1000, 1200] and state["dropped"] == 1
    state = align.empty()
    align.push(state, "lidar", 1000, 1, rules)
    assert align.close(state, rules, 1) == []
    align.push(state, "camera", 1300, 2, rules)
    assert [(r[1], r[6]) for r in align.close(state, rules, 1)] == [(1, True)]


def test_nearest_among_copies_and_ties_is_that_of_all_pairs(spark):
    """Places that several scans share, lattice ties between cells, lone points; each against all others."""
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.integers(-4, 5, (150, 3)) / 2, rng.uniform(-3, 3, (150, 3)), rng.integers(0, 3, (60, 3)) * 0.05, [[9, 9, 9], [9, 9, 9.05]], [[np.nan, 0, 0], [np.inf, 0, 0]]])
    scan, ids = rng.integers(0, 6, len(p)), rng.permutation(len(p))
    rows = [(int(i), int(s), *map(float, v)) for i, s, v in zip(ids, scan, p, strict=True)]
    t = spark.createDataFrame(rows, "id long, scan long, x double, y double, z double")
    got = {r["q"]: (r["id"], r["d2"]) for r in joins.voxel_nn(t.withColumnRenamed("id", "q"), t, 0.8, 0.8, apart="scan").collect()}
    want = {}
    for i, s, *a in rows:
        best = None
        for j, o, *b in rows:
            x, y, z = ((u - v) * (u - v) for u, v in zip(a, b, strict=True))
            d2 = x + y + z
            if o != s and d2 <= 0.8**2:
                steps = [math.floor(v / 0.8) - math.floor(u / 0.8) + 1 for u, v in zip(a, b, strict=True)]
                best = min(best or (9.0,), (d2, steps[0] * 9 + steps[1] * 3 + steps[2], j))
        if best:
            want[i] = (best[2], best[0])
    assert got == want


def test_points_among_themselves_are_dealt_by_place_once(spark):
    """As with targets of its own, all queries back if asked for, unusable ones too; what is kept of the table holds each point once."""
    rng = np.random.default_rng(13)
    rows = [(i, i % 5, *(float(v) for v in rng.integers(0, 5, 3) * 0.7)) for i in range(300)] + [(300, 1, 0.0, float("nan"), 0.0), (301, None, 0.0, 0.0, 0.0), (302, 2, 90.0, 0.0, 0.0), (303, 3, -0.0, 0.0, 0.0)]
    q = spark.createDataFrame(rows, "q long, scan long, x double, y double, z double")
    want = {r["q"]: (r["id"], r["d2"]) for r in joins.voxel_nn(q, q.withColumnRenamed("q", "id"), 0.8, 0.8, apart="scan").collect()}
    kept, real = [], joins.settle
    joins.settle = lambda df: kept.append(df.count()) or real(df)
    try:
        got = joins.voxel_nn(q, None, 0.8, 0.8, apart="scan", whole=True).collect()
    finally:
        joins.settle = real
    assert kept[0] == len(rows)
    assert {r["q"]: (r["id"], r["d2"]) for r in got if r["id"] is not None} == want
    back = {r["q"]: (r["scan"], r["x"]) for r in got}
    assert len(got) == len(rows) and back == {r[0]: (r[1], r[2]) for r in rows} and {300, 301, 302}.isdisjoint(want) and 303 in want


def test_copies_of_a_cloud_make_no_pairs(spark):
    """4,000 points in one cell, each in two scans, so that all pairs would be 64 million: none is made."""
    from posegrid.operators import joins as J

    t = spark.range(8000).selectExpr("id", "id % 2 as scan", "floor(id / 2) / 8000.0D as x", "0D as y", "0D as z")
    seen, real = [], J.grid_pairs
    J.grid_pairs = lambda q, *a, **k: seen.append(q.count()) or real(q, *a, **k)
    try:
        got = J.voxel_nn(t.withColumnRenamed("id", "q"), t, 0.8, 0.8, apart="scan")
        assert got.filter("d2 = 0 and abs(q - id) = 1").count() == 8000
    finally:
        J.grid_pairs = real
    assert seen == [0, 0]


def test_queries_go_only_to_cells_whose_targets_they_reach(spark):
    """Columns of points 1.0 apart with a reach of 0.9: of 27 cells around, only those of the own column are looked into."""
    from posegrid.operators import joins as J

    rng = np.random.default_rng(2)
    rows = [(i, i % 7, float(rng.integers(0, 12)), float(rng.uniform(0, 9)), float(rng.integers(0, 12))) for i in range(3000)]
    t = spark.createDataFrame([*rows, (3000, 1, float("nan"), 0.0, 0.0), (3001, 2, 0.1, float("nan"), 0.2)], "id long, scan long, x double, y double, z double")
    q = t.withColumnRenamed("id", "q")
    looked = J._looked_into(J.cells(q, 0.9), J.cells(t, 0.9), "xyz", (), 0.9)
    assert looked.count() <= 3 * 3000 and looked.groupBy("q", "probe").count().filter("count > 1").isEmpty()
    got = {(r["q"], r["id"]): r["d2"] for r in J.voxel_radius(q, t, 0.9, 0.9, apart="scan").collect()}
    p, scan = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    pairs = np.argwhere((d2 <= 0.9**2) & (scan[:, None] != scan[None]))
    assert got == {(int(a), int(b)): pytest.approx(d2[a, b]) for a, b in pairs}


def test_normals_shuffle_points_and_no_neighbours(spark):
    p = spark.range(400).selectExpr("id % 3 as run", "id as q", "id % 20 / 10.0D as x", "floor(id / 20) / 10.0D as y", "0D as z")
    found = aggregations.observability_scores(p, ("run",), 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert found.select("n").collect() == [(134,), (133,), (133,)] or found.agg({"n": "sum"}).first()[0] == 400


def test_a_key_stays_together_behind_a_join(spark):
    """Where a join by the keys turns into a broadcast at run time, its shuffle is read by writers; no key may be parted by that."""
    rows = [(f"r{i % 3}", i, float(i * 37 % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, t long, v double").repartition(6)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        got = {r.t: r.e for r in folds.ewma(df, ["run"], ["t"], F.col("v"), 0.1, F.floor(F.col("t") / 700), ["t"], "e").collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = {}
    for run, t, v in rows:
        state[run] = 0.9 * state[run] + 0.1 * v if run in state else v
        assert abs(got[t] - state[run]) < 1e-9, t
    assert len(got) == len(rows)
    # planned as a sort-merge join: the repartition behind it stays
    other = df.groupBy("run").agg(F.max("v").alias("most"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = folds.in_order(df.join(other, "run"), ["run"], ["t"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "REPARTITION_BY_COL" in plan
