"""Pose graphs that grow: only the poses that new edges reach are eliminated again.

Poses are eliminated in order of their number. Each keeps its factor and the message that it leaves to the poses
that come later and share an edge or a message with it; a batch of edges makes its first poses and those above them in that
tree anew and leaves all other messages as they are. Steps are bounded by a trust region; poses that have moved far from
where they were linearised are linearised again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from posegrid.functions import manifold
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import POSE, fresh, residuals
from .runs import DENSE, alike, by_runs, places, stacked

#: Translation, then rotation: how far a pose may move before it is linearised again.
RELINEARISE = np.array([0.1, 0.1, 0.1, 0.05, 0.05, 0.05])
GAUGE, DAMPING = 1e-8, 1e-9


class GrowingGraph:
    def __init__(self, relinearise: np.ndarray = RELINEARISE, radius: float = 10.0, rounds: int = 10):
        self.relinearise, self.radius, self.rounds = np.asarray(relinearise, float), radius, rounds
        self.base, self.delta = np.zeros((0, 7)), np.zeros((0, 6))
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rel, self.variance = np.zeros((0, 7)), np.zeros(0)
        self.err, self.ja, self.jb = np.zeros((0, 6)), np.zeros((0, 6, 6)), np.zeros((0, 6, 6))
        self.own: list[list[int]] = []
        self.touching: list[list[int]] = []
        self.later: list[list[int]] = []
        self.children: list[set[int]] = []
        self.factor: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.message: list[tuple[np.ndarray, np.ndarray]] = []
        self.eliminated = self.relinearised = 0

    def poses(self) -> np.ndarray:
        return manifold.boxplus(self.base, self.delta) if len(self.base) else self.base

    def _linearise(self, edges: np.ndarray) -> None:
        own = (self.a[edges], self.b[edges], self.rel[edges], self.variance[edges])
        self.err[edges], self.ja[edges], self.jb[edges] = residuals(self.base, own)

    def _off(self, pose: np.ndarray) -> np.ndarray:
        """How far the first pose is from where it is held."""
        return manifold.boxminus(pose[None], self.anchor[None])[0]

    def cost(self, delta: np.ndarray) -> float:
        """Half the weighted squared errors, at the poses themselves."""
        p = manifold.boxplus(self.base, delta)
        held = (self._off(p[0]) ** 2).sum() / GAUGE if len(p) else 0.0
        between = manifold.compose(manifold.inverse(p[self.a]), p[self.b])
        err = manifold.log(manifold.compose(manifold.inverse(self.rel), between))
        return float(((err**2).sum(1) / self.variance).sum() + held) / 2

    def _along(self, delta: np.ndarray) -> np.ndarray:
        """How the errors change along ``delta``, to first order."""
        return np.einsum("nij,nj->ni", self.ja, delta[self.a]) + np.einsum("nij,nj->ni", self.jb, delta[self.b])

    def _model(self, delta: np.ndarray) -> float:
        r = self.err + self._along(delta)
        return float(((r**2).sum(1) / self.variance).sum() + ((self._off(self.base[0]) + delta[0]) ** 2).sum() / GAUGE) / 2

    def _gradient(self) -> np.ndarray:
        g = np.zeros_like(self.delta)
        weighted = self.err / self.variance[:, None]
        np.add.at(g, self.a, np.einsum("nji,nj->ni", self.ja, weighted))
        np.add.at(g, self.b, np.einsum("nji,nj->ni", self.jb, weighted))
        g[0] += self._off(self.base[0]) / GAUGE
        return g

    def _eliminate(self, start: set[int]) -> set[int]:
        """Make the factors of ``start`` and of all above them anew; returns those."""
        queue, done = sorted(start), set()
        while queue:
            k = heapq.heappop(queue)
            if k in done:
                continue
            done.add(k)
            old = self.later[k][0] if self.later[k] else None
            later = sorted({max(int(self.a[e]), int(self.b[e])) for e in self.own[k]}.union(*(self.later[c] for c in self.children[k])) - {k})
            size = 6 * (1 + len(later))
            place = {v: 6 * i for i, v in enumerate([k, *later])}
            h, g = np.zeros((size, size)), np.zeros(size)
            for e in self.own[k]:
                i, j, w = place[int(self.a[e])], place[int(self.b[e])], 1 / self.variance[e]
                ja, jb, err = self.ja[e], self.jb[e], self.err[e]
                h[i : i + 6, i : i + 6] += w * ja.T @ ja
                h[j : j + 6, j : j + 6] += w * jb.T @ jb
                h[i : i + 6, j : j + 6] += w * ja.T @ jb
                h[j : j + 6, i : i + 6] += w * jb.T @ ja
                g[i : i + 6] += w * ja.T @ err
                g[j : j + 6] += w * jb.T @ err
            for c in self.children[k]:
                at = np.concatenate([np.arange(place[v], place[v] + 6) for v in self.later[c]])
                m, v = self.message[c]
                h[np.ix_(at, at)] += m
                g[at] += v
            h[:6, :6] += (1 / GAUGE if k == 0 else DAMPING) * np.eye(6)
            if k == 0:
                g[:6] += self._off(self.base[0]) / GAUGE
            inverse = np.linalg.inv(h[:6, :6])
            weight = h[6:, :6] @ inverse
            self.factor[k] = (inverse, weight, g[:6])
            self.message[k] = (h[6:, 6:] - weight @ h[:6, 6:], g[6:] - weight @ g[:6])
            self.later[k] = later
            parent = later[0] if later else None
            if old is not None and old != parent:
                self.children[old].discard(k)
                heapq.heappush(queue, old)
            if parent is not None:
                self.children[parent].add(k)
                heapq.heappush(queue, parent)
        self.eliminated += len(done)
        return done

    def _newton(self, made: set[int], tolerance: float = 1e-12) -> np.ndarray:
        """The step of the whole system; below poses that don't change nothing is looked at."""
        out = self.newton.copy()
        queue, seen = [-k for k in made], set()
        heapq.heapify(queue)
        while queue:
            k = -heapq.heappop(queue)
            if k in seen:
                continue
            seen.add(k)
            inverse, weight, g = self.factor[k]
            later = self.later[k]
            step = -inverse @ g - (weight.T @ out[later].ravel() if later else 0.0)
            changed = np.abs(step - out[k]).max() > tolerance
            out[k] = step
            if changed:
                for c in self.children[k]:
                    heapq.heappush(queue, -c)
        return out

    def _dogleg(self, newton: np.ndarray) -> np.ndarray:
        """Within the trust region: Newton's step, the steepest descent's, or where the way from this to that leaves the region."""
        if np.linalg.norm(newton) <= self.radius:
            return newton
        g = self._gradient()
        r = self._along(g)
        bend = float(((r**2).sum(1) / self.variance).sum() + (g[0] ** 2).sum() / GAUGE)
        descent = -g * (float((g * g).sum()) / max(bend, 1e-300))
        if np.linalg.norm(descent) >= self.radius:
            return descent * (self.radius / np.linalg.norm(descent))
        d = newton - descent
        a, b, c = float((d * d).sum()), 2 * float((d * descent).sum()), float((descent * descent).sum()) - self.radius**2
        return descent + d * ((-b + np.sqrt(b * b - 4 * a * c)) / (2 * a))

    def add(self, poses: np.ndarray, a: np.ndarray, b: np.ndarray, rel: np.ndarray, variance: np.ndarray) -> dict:
        """Append poses (first guesses) and edges between any; returns what was done."""
        n, first = len(self.base), len(self.a)
        before = self.poses()
        if not n:
            self.anchor = poses[0].copy()
        self.base, self.delta = np.concatenate([self.base, poses]), np.concatenate([self.delta, np.zeros((len(poses), 6))])
        self.newton = np.concatenate([self.newton, np.zeros((len(poses), 6))]) if n else np.zeros((len(poses), 6))
        for _ in range(len(poses)):
            for lists in (self.own, self.touching, self.later):
                lists.append([])
            self.children.append(set())
            self.factor.append((np.eye(6), np.zeros((0, 6)), np.zeros(6)))
            self.message.append((np.zeros((0, 0)), np.zeros(0)))
        self.a, self.b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        self.rel, self.variance = np.concatenate([self.rel, rel]), np.concatenate([self.variance, variance])
        self.err = np.concatenate([self.err, np.zeros((len(a), 6))])
        self.ja, self.jb = (np.concatenate([j, np.zeros((len(a), 6, 6))]) for j in (self.ja, self.jb))
        for e in range(first, len(self.a)):
            i, j = int(self.a[e]), int(self.b[e])
            self.own[min(i, j)].append(e)
            self.touching[i].append(e)
            self.touching[j].append(e)
        if len(a):
            self._linearise(np.arange(first, len(self.a)))
        self.eliminated = self.relinearised = 0
        start = {*range(n, len(self.base)), *np.minimum(a, b).tolist()}
        self._improve(start)
        moved = np.abs(manifold.boxminus(self.poses()[:n], before)).max(axis=1) if n else np.zeros(0)
        return {"eliminated": self.eliminated, "relinearised": self.relinearised, "moved": int((moved > 1e-3).sum()), "cost": self.cost(self.delta)}

    def _improve(self, start: set[int]) -> None:
        for _ in range(self.rounds):
            self.newton = self._newton(self._eliminate(start))
            here, model = self.cost(self.delta), self._model(self.delta)
            for _ in range(20):
                step = self._dogleg(self.newton)
                new = self.cost(step)
                expected = model - self._model(step)
                ratio = (here - new) / expected if expected > 1e-12 else 1.0
                if new <= here + 1e-12 * max(1.0, here) or np.abs(step - self.delta).max() < 1e-10:
                    break
                self.radius = min(self.radius, float(np.linalg.norm(step))) / 2
            else:
                step = self.delta
            if ratio > 0.75 and np.linalg.norm(self.newton) > self.radius:
                self.radius *= 2
            self.delta = step
            far = np.flatnonzero((np.abs(self.delta) > self.relinearise).any(axis=1))
            if not len(far):
                return
            self.base[far] = manifold.boxplus(self.base[far], self.delta[far])
            self.delta[far] = 0.0
            self.newton[far] = 0.0
            edges = np.array(sorted({e for k in far.tolist() for e in self.touching[k]}), np.int64)
            self._linearise(edges)
            self.relinearised += len(far)
            start = set(np.minimum(self.a[edges], self.b[edges]).tolist()) | set(far.tolist())


OUT = "run long, batch long, n long, edges long, eliminated long, relinearised long, moved long, cost double"


def grow(nodes: pd.DataFrame, edges: pd.DataFrame, relinearise: np.ndarray, rounds: int) -> tuple[GrowingGraph, list[int], list[dict]]:
    """One run's batches, one after the other; an edge comes with the later of its own batch and those of its ends."""
    nodes = nodes.sort_values(["batch", "id"], kind="stable").drop_duplicates("id")
    place = {i: k for k, i in enumerate(nodes["id"])}
    edges = edges[edges["a"].isin(place) & edges["b"].isin(place) & (edges["a"] != edges["b"])]
    of_node = dict(zip(nodes["id"], nodes["batch"], strict=True))
    due = np.maximum(edges["batch"].to_numpy(np.int64), np.maximum(edges["a"].map(of_node).to_numpy(np.int64), edges["b"].map(of_node).to_numpy(np.int64))) if len(edges) else np.zeros(0, np.int64)
    graph, rows = GrowingGraph(relinearise, rounds=rounds), []
    for batch in sorted({*nodes["batch"].tolist(), *due.tolist()}):
        own, new = nodes[nodes["batch"] == batch], edges[due == batch]
        done = graph.add(own[POSE].to_numpy(float).reshape(-1, 7), new["a"].map(place).to_numpy(np.int64), new["b"].map(place).to_numpy(np.int64), new[POSE].to_numpy(float).reshape(-1, 7), new["variance"].to_numpy(float))
        rows.append({"batch": batch, "n": len(own), "edges": len(new)} | done)
    return graph, nodes["id"].tolist(), rows


def _grouped(nodes: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    keep = ["run", "batch", "a", "b", *POSE, "variance"]
    return nodes.groupBy("run").cogroup(fresh(edges.select(*keep)).groupBy("run")).applyInPandas(run, schema)


def _parents(edges: np.ndarray) -> np.ndarray:
    """(runs, places): the first later pose that each shares an edge or a message with, -1 for none; edges (runs, places, places) from the earlier end."""
    fill, out = edges.copy(), np.full(edges.shape[:2], -1)
    for k in range(edges.shape[1]):
        has = np.flatnonzero(fill[:, k].any(axis=1))
        up = fill[has, k].argmax(axis=1)
        out[has, k] = up
        fill[has, up] |= fill[has, k]
        fill[has, up, up] = False
    return out


def grow_many(base: np.ndarray, of: np.ndarray, edges: tuple[np.ndarray, ...], node_step: np.ndarray, edge_step: np.ndarray, relinearise: np.ndarray, radius: float = 10.0) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Batches of runs of equal length: poses (runs, places, 7), edges between places of the run ``of``, and the numbers of the batches that they come with.

    As long as a batch is settled by one Newton step within the trust region and nothing has to be linearised again, the factors
    that a growing graph keeps are those of the whole system, so the whole system of each run is solved, all of them at once.
    Returns which runs stayed so, and for each step (runs, eliminated, moved, cost) of all; those of the other runs mean nothing.
    """
    count, n = base.shape[:2]
    a, b = of * n + edges[0], of * n + edges[1]
    flat, own = base.reshape(-1, 7), (a, b, *edges[2:])
    err, ja, jb = residuals(flat, own)
    w = 1 / edges[3]
    low, high = np.minimum(edges[0], edges[1]), np.maximum(edges[0], edges[1])
    good, steps = np.ones(count, bool), []
    delta, parent = np.zeros((count, n, 6)), np.full((count, n), -1)
    total = 1 + node_step.max(axis=1)
    np.maximum.at(total, of, 1 + edge_step)

    def moved(to: np.ndarray) -> np.ndarray:
        return manifold.boxplus(flat, to.reshape(-1, 6))

    def held(p: np.ndarray) -> np.ndarray:
        return manifold.boxminus(p.reshape(count, n, 7)[:, 0], base[:, 0])

    for t in range(int(total.max())):
        due, here = edge_step <= t, node_step <= t
        h, g = stacked(count, n, a[due], b[due], w[due], err[due], ja[due], jb[due])
        g[:, 0] += held(flat) / GAUGE
        diagonal = np.where(here, DAMPING, 1.0)
        diagonal[:, 0] = 1 / GAUGE
        h[:, np.arange(6 * n), np.arange(6 * n)] += np.repeat(diagonal, 6, axis=1)
        step = np.linalg.solve(h, -g.reshape(count, -1, 1)).reshape(count, n, 6)

        def cost(to: np.ndarray, due: np.ndarray = due) -> np.ndarray:
            p = moved(to)
            e = manifold.log(manifold.compose(manifold.inverse(edges[2][due]), manifold.compose(manifold.inverse(p[a[due]]), p[b[due]])))
            return (np.bincount(of[due], (e**2).sum(1) * w[due], count) + (held(p) ** 2).sum(1) / GAUGE) / 2

        before, after = cost(delta), cost(step)
        settled = (after <= before + 1e-12 * np.maximum(1.0, before)) | (np.abs(step - delta).max(axis=(1, 2)) < 1e-10)
        plain = settled & (np.linalg.norm(step.reshape(count, -1), axis=1) <= radius) & ~(np.abs(step) > relinearise).any(axis=(1, 2))
        active = t < total
        good &= plain | ~active

        linked = np.zeros((count, n, n), bool)
        linked[of[due], low[due], high[due]] = True
        now, dirty = _parents(linked), node_step == t
        dirty[of[edge_step == t], low[edge_step == t]] = True
        for k in range(n):
            for up in (now[:, k], np.where(parent[:, k] != now[:, k], parent[:, k], -1)):
                runs = np.flatnonzero(dirty[:, k] & (up >= 0))
                dirty[runs, up[runs]] = True
        shift = np.abs(manifold.boxminus(moved(step), moved(delta))).max(axis=1).reshape(count, n)
        runs = np.flatnonzero(active)
        steps.append((runs, dirty.sum(1)[runs], ((shift > 1e-3) & (node_step < t)).sum(1)[runs], after[runs]))
        delta, parent = step, now
    return good, steps


def graph_updates(nodes: DataFrame, edges: DataFrame, relinearise: np.ndarray = RELINEARISE, rounds: int = 10) -> DataFrame:
    """``OUT`` for each batch of each run: how many poses were eliminated and linearised again, how many older ones moved by over a millimetre or milliradian.

    nodes: run, batch, id, pose; edges: run, batch, a, b, relative pose, variance. Runs are independent and go through in blocks: those of
    equal length together as long as each batch is one plain step (see grow_many), others each with its growing graph.
    Edges without an end are left out, of a repeated id the first counts.
    """
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(count: int, sides: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, e = sides
        n = n.sort_values(["run", "batch", "id"], kind="stable").drop_duplicates(["run", "id"]).reset_index(drop=True)
        starts, size, find = places(n, count)
        of = e["run"].to_numpy()
        a, b = (find(of, e[c].to_numpy()) for c in ("a", "b"))
        keep = (a >= 0) & (b >= 0) & (a != b)
        e, of, a, b = e[keep].reset_index(drop=True), of[keep], a[keep], b[keep]
        came = n["batch"].to_numpy(np.int64)
        due = np.maximum(e["batch"].to_numpy(np.int64), np.maximum(came[starts[of] + a], came[starts[of] + b])) if len(e) else np.zeros(0, np.int64)
        # batches of each run by their number
        every = pd.DataFrame({"run": np.concatenate([n["run"].to_numpy(), of]), "batch": np.concatenate([came, due])})
        batches, number = np.unique(every.to_numpy(np.int64), axis=0, return_inverse=True)
        number = number.ravel()
        first = np.searchsorted(batches[:, 0], np.arange(count))
        step = number - first[every["run"].to_numpy(np.int64)]
        node_step, edge_step = step[: len(n)], step[len(n) :]
        new, more = np.bincount(number[: len(n)], minlength=len(batches)), np.bincount(number[len(n) :], minlength=len(batches))
        poses, own = n[POSE].to_numpy(float), (a, b, e[POSE].to_numpy(float), e["variance"].to_numpy(float))
        order = np.argsort(of, kind="stable")
        many = np.bincount(of, minlength=count)
        begin = np.cumsum(many) - many
        out, single = np.zeros((len(batches), 3)), []
        for length, runs in alike(size):
            if length > DENSE:
                single += runs.tolist()
                continue
            rows = starts[runs][:, None] + np.arange(length)
            at = order[np.repeat(begin[runs] - (np.cumsum(many[runs]) - many[runs]), many[runs]) + np.arange(many[runs].sum())]
            good, steps = grow_many(poses[rows], np.repeat(np.arange(len(runs)), many[runs]), tuple(c[at] for c in own), node_step[rows], edge_step[at], np.asarray(relinearise, float))
            for t, (which, *found) in enumerate(steps):
                out[first[runs[which]] + t] = np.stack(found, axis=1)
            single += runs[~good].tolist()
        plain = ~np.isin(batches[:, 0], single)
        yield pd.DataFrame({"run": batches[:, 0], "batch": batches[:, 1], "n": new, "edges": more, "eliminated": out[:, 0].astype(np.int64), "relinearised": 0, "moved": out[:, 1].astype(np.int64), "cost": out[:, 2]})[plain]
        ends = np.searchsorted(of[order], np.arange(count + 1))
        for k in single:
            rows = grow(n.iloc[starts[k] : starts[k] + size[k]], e.iloc[order[ends[k] : ends[k + 1]]], relinearise, rounds)[2]
            yield pd.DataFrame(rows, columns=names).assign(run=k)

    return by_runs([nodes.select("run", "batch", "id", *POSE), edges.filter("a is not null and b is not null").select("run", "batch", "a", "b", *POSE, "variance")], run, OUT)


def grown_poses(nodes: DataFrame, edges: DataFrame, relinearise: np.ndarray = RELINEARISE, rounds: int = 10) -> DataFrame:
    """run, id and pose after the last batch; see graph_updates."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame(columns=["run", "id", *POSE])
        graph, ids, _ = grow(n, e, relinearise, rounds)
        return pd.DataFrame(graph.poses(), columns=POSE).assign(run=n["run"].iloc[0], id=ids)[["run", "id", *POSE]]

    return _grouped(nodes, edges, run, "run long, id long, " + ", ".join(f"{c} double" for c in POSE))


def batched_by(nodes: DataFrame, edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``batch``: ``size`` ids each; an edge comes with its later end."""
    return nodes.withColumn("batch", F.floor(F.col("id") / size)), edges.withColumn("batch", F.floor(F.greatest("a", "b") / size))
