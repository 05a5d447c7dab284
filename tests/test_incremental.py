"""The growing pose graph against the batch solver, its work, and its trust region; local planes against numpy."""

import numpy as np
import pandas as pd
import pytest
from posegrid.functions import manifold
from posegrid.operators import aggregations, graph, incremental


def spiral(rng, n, loops, noise=0.01, bad=False):
    """Poses on a spiral, a noisy chain, and loops between far places; the first guesses drift."""
    t = np.arange(n) * 0.15
    truth = manifold.exp(np.stack([0 * t, 0 * t, 0 * t, 0.02 * np.sin(t), 0.02 * np.cos(t), t], axis=1))
    truth[:, 4:] = np.stack([2 * np.cos(t) * (1 + t / 20), 2 * np.sin(t) * (1 + t / 20), 0.05 * t], axis=1)
    pairs = [(i, i + 1) for i in range(n - 1)] + loops
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    rel = manifold.boxplus(manifold.compose(manifold.inverse(truth[a]), truth[b]), rng.normal(0, noise, (len(a), 6)))
    guess = [truth[:1]]
    for i in range(n - 1):
        guess.append(manifold.compose(guess[-1], rel[i : i + 1]))
    guess = np.concatenate(guess)
    if bad:
        guess = np.concatenate([guess[:1], manifold.boxplus(guess[1:], rng.normal(0, 0.3, (n - 1, 6)))])
    return truth, guess, (a, b, rel, np.full(len(a), 1e-4))


def fold(guess, edges, size, **settings):
    g, work = incremental.GrowingGraph(**settings), []
    a, b, rel, var = edges
    for s in range(0, len(guess), size):
        now = (np.maximum(a, b) >= s) & (np.maximum(a, b) < s + size)
        work.append(g.add(guess[s : s + size], a[now], b[now], rel[now], var[now]))
    return g, work


@pytest.mark.parametrize(("size", "bad"), [(1, False), (7, False), (60, True), (1000, False)])
def test_fold_by_batches_is_the_batch_solution(size, bad):
    rng = np.random.default_rng(4)
    _, guess, edges = spiral(rng, 120, [(0, 42), (3, 45), (10, 90), (50, 92), (60, 61), (119, 5)], bad=bad)
    g, _ = fold(guess, edges, size, relinearise=np.full(6, 1e-9), rounds=60)
    batch = graph.solve(guess, edges, 60)
    assert np.abs(manifold.boxminus(g.poses(), batch)).max() < 1e-6
    assert np.isclose(g.cost(g.delta), ((graph.residuals(batch, edges)[0] ** 2).sum(1) / edges[3]).sum() / 2, rtol=1e-6)


def test_work_follows_what_new_edges_reach():
    rng = np.random.default_rng(1)
    _, guess, edges = spiral(rng, 400, [(380, 396)])
    _, work = fold(guess, edges, 4)
    # a batch without a loop touches its own poses and the one before; the loop those from its start on
    assert all(w["eliminated"] <= 5 for w in work[1:99]) and 17 <= work[99]["eliminated"] <= 5 * 25
    assert all(w["moved"] <= 1 for w in work[:99])


def test_default_thresholds_stay_near_the_batch_solution():
    rng = np.random.default_rng(3)
    truth, guess, edges = spiral(rng, 200, [(i, i + 42) for i in range(0, 150, 10)])
    g, work = fold(guess, edges, 5)
    batch = graph.solve(guess, edges, 60)
    gap = np.abs(manifold.boxminus(g.poses(), batch))
    assert gap[:, :3].max() < 0.05 and gap[:, 3:].max() < 0.02
    assert np.linalg.norm(g.poses()[:, 4:] - truth[:, 4:], axis=1).mean() < np.linalg.norm(guess[:, 4:] - truth[:, 4:], axis=1).mean()
    assert sum(w["moved"] for w in work) > 100


def test_cost_never_rises_within_a_trust_region():
    rng = np.random.default_rng(9)
    _, guess, edges = spiral(rng, 40, [(0, 39), (5, 30)], bad=True)
    g = incremental.GrowingGraph(np.full(6, 1e-9), radius=0.05, rounds=1)
    g.add(guess, *edges)
    costs = [g.cost(g.delta)]
    for _ in range(120):
        g._improve(set(range(40)))
        costs.append(g.cost(g.delta))
    assert all(b <= a * (1 + 1e-9) for a, b in zip(costs, costs[1:], strict=False))
    assert np.abs(manifold.boxminus(g.poses(), graph.solve(guess, edges, 80))).max() < 1e-5


def test_runs_in_spark(spark):
    rng = np.random.default_rng(2)
    nodes, edges, want = [], [], {}
    for run in (1, 2):
        _, guess, (a, b, rel, var) = spiral(rng, 30, [(0, 25), (4, 29)])
        nodes += [(run, i // 6, i, *p) for i, p in enumerate(guess.tolist())] + [(run, 4, 3, *guess[0].tolist())]
        edges += [(run, 0, int(i), int(j), *r, float(v)) for i, j, r, v in zip(a, b, rel.tolist(), var, strict=True)] + [(run, 0, 5, 999, *rel[0].tolist(), 1e-4)]
        want[run] = graph.solve(guess, (a, b, rel, var), 60)
    pose = ", ".join(f"{c} double" for c in manifold.POSE)
    n, e = spark.createDataFrame(nodes, f"run long, batch long, id long, {pose}"), spark.createDataFrame(edges, f"run long, batch long, a long, b long, {pose}, variance double")
    got = incremental.grown_poses(n, e, np.full(6, 1e-9), 60).orderBy("run", "id").toPandas()
    for run, p in want.items():
        assert np.abs(manifold.boxminus(got[got["run"] == run][list(manifold.POSE)].to_numpy(), p)).max() < 1e-6
    rows = incremental.graph_updates(n, e).orderBy("run", "batch").collect()
    assert [(r.run, r.batch, r.n) for r in rows] == [(run, k, 6) for run in (1, 2) for k in range(5)]
    assert sum(r.edges for r in rows) == 62
    assert incremental.graph_updates(n.filter("run < 0"), e.filter("run < 0")).collect() == []


def test_observability_by_columns(spark):
    rng = np.random.default_rng(6)
    room = np.concatenate([np.stack([rng.random(200) * 3, rng.random(200) * 3, rng.normal(0, 0.01, 200)], axis=1), np.stack([rng.normal(0, 0.01, 150), rng.random(150) * 3, rng.random(150) * 3], axis=1)]) + [50, -20, 0]
    floor = np.stack([rng.random(150) * 3, rng.random(150) * 3, np.zeros(150)], axis=1)
    line = np.stack([np.linspace(0, 1, 30), np.zeros(30), np.zeros(30)], axis=1)
    few = rng.random((4, 3)) * 0.1
    data = {1: room, 2: floor, 3: line, 4: few, 5: np.repeat(few[:1], 9, axis=0)}
    df = spark.createDataFrame([(k, i, *p) for k, points in data.items() for i, p in enumerate(points.tolist())], "run long, q long, x double, y double, z double")
    got = {r.run: tuple(r)[1:] for r in aggregations.observability_scores(df, ("run",), 0.6).collect()}
    for k, points in data.items():
        d2 = ((points[:, None] - points[None]) ** 2).sum(2)
        rows = []
        for i, p in enumerate(points):
            near = points[d2[i] <= 0.36]
            value, vector = np.linalg.eigh((near - near.mean(0)).T @ (near - near.mean(0)))
            if len(near) >= 5 and value[1] > max(1e-12, 1e-6 * value[2]):
                rows.append(np.concatenate([vector[:, 0], np.cross(p, vector[:, 0])]))
        h = (np.array(rows) ** 2).mean(0) if rows else np.zeros(6)
        assert got[k][0] == len(rows)
        assert np.allclose(got[k][1:], h / (h + 0.01), atol=1e-6)
    assert got[2][3] > 0.9 and max(got[2][1], got[2][2], got[2][6]) < 1e-9
    assert got[3] == got[4] == got[5] == (0, 0, 0, 0, 0, 0, 0)
