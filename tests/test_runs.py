"""Estimates along runs, many runs at once, against one run at a time."""

import numpy as np
import pandas as pd
from posegrid.functions import manifold
from posegrid.plans import windows


def test_many_short_runs_take_as_many_steps_as_the_longest(monkeypatch):
    """2,000 runs of 1 to 20 poses in one block: 19 steps, not one for each pose."""
    rng = np.random.default_rng(3)
    size = rng.integers(1, 21, 2000)
    size[0] = 20
    starts, n = np.cumsum(size) - size, int(size.sum())
    steps = list(windows._steps(n, starts))
    assert len(steps) == 19 and sorted(np.concatenate([at for _, at in steps]).tolist()) == sorted(set(range(n)) - set(starts.tolist()))


def test_runs_in_blocks_give_what_single_runs_give(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    own = np.repeat([5, 6, 7, 8, 9], [1, 40, 3, 2, 14])
    orders = pd.DataFrame({"o_custkey": own, "o_orderdate": (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(60), "D")).astype("datetime64[us]"), "o_orderkey": np.arange(60) * 7, "o_totalprice": rng.uniform(0, 1e5, 60)})
    orders.to_parquet(tmp_path / "orders.parquet")
    monkeypatch.setattr(windows, "BLOCK", 8)
    got = windows.section.queries["chain_cov"](spark, str(tmp_path)).toPandas().set_index("run")
    for run, rows in orders.groupby("o_custkey"):
        yaw = np.radians(rows["o_orderkey"].to_numpy() % 360)
        zero = 0 * yaw
        p = np.stack([zero, zero, np.sin(yaw / 2), np.cos(yaw / 2), rows["o_totalprice"] / 1e5, rows["o_orderkey"] % 997 / 100, zero], axis=1)
        cov = np.zeros((6, 6))
        for i in range(1, len(p)):
            a = manifold.adjoint(manifold.compose(manifold.inverse(p[i : i + 1]), p[i - 1 : i]))[0]
            cov = a @ cov @ a.T + np.eye(6) * 1e-4
        assert got.loc[run, "n"] == len(p) and abs(got.loc[run, "trace"] - np.trace(cov)) < 1e-5


def test_a_segment_of_a_chain_has_the_steps_between_its_ends(spark, tmp_path):
    """What is left of the end's covariance without that up to the start is that of the segment's own steps; nothing where there is none."""
    rng = np.random.default_rng(11)
    own = np.repeat([3, 4, 9], [1, 9, 4])
    orders = pd.DataFrame({"o_custkey": own, "o_orderdate": (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(14), "D")).astype("datetime64[us]"), "o_orderkey": np.arange(14) * 11, "o_totalprice": rng.uniform(0, 1e5, 14)})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = windows.section.queries["chain_cov"](spark, str(tmp_path)).toPandas().set_index("run")["between"]
    for run, rows in orders.groupby("o_custkey"):
        yaw = np.radians(rows["o_orderkey"].to_numpy() % 360)
        zero = 0 * yaw
        p = np.stack([zero, zero, np.sin(yaw / 2), np.cos(yaw / 2), rows["o_totalprice"] / 1e5, rows["o_orderkey"] % 997 / 100, zero], axis=1)
        for b, found in enumerate(got[run]):
            if b < 3:
                assert found is None or np.isnan(found)
                continue
            cov = np.zeros((6, 6))
            for i in range(b - 2, b + 1):
                a = manifold.adjoint(manifold.compose(manifold.inverse(p[i : i + 1]), p[i - 1 : i]))[0]
                cov = a @ cov @ a.T + np.eye(6) * 1e-4
            assert abs(found - np.trace(cov)) < 1e-5
        assert len(got[run]) == len(p)
    # ends in the wrong order, the same end twice, one that isn't known
    poses = np.tile([0.0, 0, 0, 1, 1, 2, 3], (3, 1))
    cov = np.arange(3)[:, None, None] * np.eye(6)
    between = windows._between(poses, cov, np.array([0, 2, 1, -1]), np.array([2, 0, 1, 2]))
    assert np.allclose(between[0], 2 * np.eye(6)) and np.isnan(between[1:]).all()


POSED = "qx double, qy double, qz double, qw double, tx double, ty double, tz double"


def some_graphs(rng, sizes):
    """Chains with loops between every second pose and the one three before it, some far off; nodes, chain, loops as pandas."""
    nodes, chain, loops = [], [], []
    for run, n in enumerate(sizes):
        yaw = rng.uniform(-1, 1, n)
        p = np.stack([0 * yaw, 0 * yaw, np.sin(yaw / 2), np.cos(yaw / 2), *rng.uniform(0, 3, (2, n)), 0 * yaw], axis=1)
        nodes += [[run, i, *p[i]] for i in range(n)]
        for gap, out in ((1, chain), (3, loops)):
            for b in range(gap, n, 1 if gap == 1 else 2):
                rel = manifold.compose(manifold.inverse(p[b - gap : b - gap + 1]), p[b : b + 1])[0]
                rel[4] += 0.0 if gap == 1 else 2.0 if (run + b) % 5 == 0 else 0.001
                out.append([run, b - gap, b, *rel, 1e-4])
    pose = list(manifold.POSE)
    of = lambda rows: pd.DataFrame(rows, columns=["run", "a", "b", *pose, "variance"])
    return pd.DataFrame(nodes, columns=["run", "id", *pose]), of(chain), of(loops).assign(loop=lambda e: e["a"] * 1000 + e["b"])


def alone(graph, nodes, edges, run):
    n = nodes[nodes["run"] == run].reset_index(drop=True)
    return n[list(manifold.POSE)].to_numpy(float), graph.as_edges(edges[edges["run"] == run], {i: k for k, i in enumerate(n["id"])})


def test_graphs_of_many_runs_give_what_single_runs_give(spark):
    from posegrid.operators import graph

    nodes, chain, loops = some_graphs(np.random.default_rng(5), [1, 7, 7, 12, 40, 4])
    good = loops[(loops["run"] + loops["b"]) % 5 != 0].drop(columns="loop")
    both = pd.concat([chain, good], ignore_index=True)
    frames = [spark.createDataFrame(x) for x in (nodes, both, chain, loops)]
    got = graph.pose_graph_optimize(*frames[:2]).toPandas().sort_values(["run", "id"])
    weights = graph.gnc_consolidate(frames[0], *frames[2:], 16.8119).toPandas().sort_values(["run", "loop"])
    traces = graph.marginals(frames[0], frames[2], 1e-8).toPandas().sort_values(["run", "id"])
    for run in range(1, 6):
        poses, edges = alone(graph, nodes, both, run)
        of = lambda x: x[x["run"] == run]  # noqa: E731, B023
        assert np.abs(of(got)[list(manifold.POSE)].to_numpy() - graph.solve(poses, edges)).max() < 1e-7
        own = alone(graph, nodes, chain, run)[1]
        assert np.allclose(of(traces)["trace"], np.trace(graph.marginal_blocks(poses, own, 1e-8)[:, :3, :3], axis1=1, axis2=2), rtol=1e-7)
        assert np.abs(of(weights)["weight"].to_numpy() - graph.gnc_weights(poses, own, alone(graph, nodes, loops.sort_values(["run", "loop"]), run)[1], 16.8119)[0]).max() < 1e-6


def test_steps_of_many_runs_are_as_many_as_those_of_one(monkeypatch):
    """200 runs of nine poses: the edges of all of them are worked out at once, ten times at most."""
    from posegrid.operators import graph

    nodes, chain, _ = some_graphs(np.random.default_rng(6), [9] * 200)
    calls, real = [], graph.residuals
    monkeypatch.setattr(graph, "residuals", lambda *a: calls.append(1) or real(*a))
    block = graph.Blocked(200, nodes, chain)
    for _, rows, at, of in block.stacks():
        graph.solve_many(block.poses[rows], of, tuple(c[at] for c in block.own))
    assert len(calls) <= 10


def test_plain_growth_of_many_runs_is_that_of_single_graphs(spark):
    """Runs that settle by plain steps, one with a loop far off that has to be linearised again, and one that is longer than a stack takes."""
    from posegrid.operators import incremental

    nodes, chain, loops = some_graphs(np.random.default_rng(7), [1, 9, 9, 14, 36, 11])
    good = loops[(loops["run"] + loops["b"]) % 5 != 0].drop(columns="loop")
    far = loops[loops["run"] == 5].drop(columns="loop")
    edges = pd.concat([chain, good, far], ignore_index=True)
    n, e = incremental.batched_by(spark.createDataFrame(nodes), spark.createDataFrame(edges), 4)
    got = incremental.graph_updates(n, e).toPandas().sort_values(["run", "batch"]).reset_index(drop=True)
    n, e = n.toPandas(), e.toPandas()
    want = [{"run": k} | row for k in range(6) for row in incremental.grow(n[n["run"] == k], e[e["run"] == k], incremental.RELINEARISE, 10)[2]]
    want = pd.DataFrame(want)[got.columns]
    counts = ["run", "batch", "n", "edges", "eliminated", "relinearised", "moved"]
    assert got[counts].equals(want[counts].astype("int64")) and np.allclose(got["cost"], want["cost"], rtol=1e-6, atol=1e-7)
    assert want["relinearised"].sum() > 0


def test_growing_graphs_are_made_only_for_runs_that_need_one(spark, monkeypatch):
    from posegrid.operators import incremental

    nodes, chain, _ = some_graphs(np.random.default_rng(8), [9] * 50)
    block = [nodes.assign(batch=nodes["id"] // 5), chain.assign(batch=chain["b"] // 5)]
    monkeypatch.setattr(incremental, "by_runs", lambda sides, f, schema: pd.concat(f(50, block)))
    monkeypatch.setattr(incremental, "GrowingGraph", None)
    n, e = incremental.batched_by(spark.createDataFrame(nodes), spark.createDataFrame(chain), 5)
    assert len(incremental.graph_updates(n, e)) == 100


def test_small_systems_are_solved_in_stacks(monkeypatch):
    """Sound, spoilt and rank-deficient systems: each as by itself, with few calls."""
    from posegrid.operators import graph

    rng = np.random.default_rng(9)
    p = rng.uniform(1, 500, (3000, 4, 2))
    p[::7, 1:] = 0
    h = p.transpose(0, 2, 1) @ p
    h[::2, 0, 0] -= 2 * (p[::2] ** 2).sum((1, 2))
    h[5], g = 0.0, p.sum(1)
    want = [graph.solve_or_drop(a, b)[1] for a, b in zip(h, g, strict=True)]
    assert graph.solved_how(h, g) == want and {"cholesky", "qr", "dropped"} == set(want)
    calls, real = [], graph.solve_or_drop
    monkeypatch.setattr(graph, "solve_or_drop", lambda *a: calls.append(1) or real(*a))
    graph.solved_how(h[np.arange(3000) % 7 > 0], g[np.arange(3000) % 7 > 0])
    assert len(calls) <= 1


def test_distortion_is_undone_in_as_many_steps_as_it_needs(monkeypatch):
    from posegrid.functions import geometry

    x, y = np.meshgrid(np.linspace(-0.5, 0.5, 40), np.linspace(-0.5, 0.5, 40))
    x, y = x.ravel(), y.ravel()
    dx, dy = geometry.distort_radtan(x, y, 0.05, -0.01, 0.001, 0.0005)
    rows, real = [], geometry.distort_radtan
    monkeypatch.setattr(geometry, "distort_radtan", lambda u, *a: rows.append(len(u)) or real(u, *a))
    got = geometry.undistorted(dx, dy, 0.05, -0.01, 0.001, 0.0005, 40)
    assert np.abs(got[0] - x).max() < 1e-12 and np.abs(got[1] - y).max() < 1e-12 and sum(rows) < 40 * len(x)


def test_pixels_in_batches_are_those_of_the_expressions(spark):
    from posegrid.functions import geometry
    from pyspark.sql import functions as F

    lens = (400.0, 410.0, 320.0, 240.0, 0.01, -0.002, 0.001, 0.0005)
    rows = np.random.default_rng(10).uniform(-1, 3, (50, 3))
    rows[0, 2] = 0.0
    p = tuple(F.col(c) for c in "xyz")
    df = spark.createDataFrame(pd.DataFrame(rows, columns=list("xyz")))
    want = df.select(*geometry.project(p, *lens), *geometry.project_jacobian(p, *lens[:2], *lens[4:])).toPandas().to_numpy(float)
    assert np.array_equal(geometry.project_many(rows, *lens), want, equal_nan=True)
