"""Graphs of many runs at once: blocks of whole runs, and runs of equal length as stacks of dense systems.

A run has few poses and there are many of them, so a call for each run costs more than its numbers. Rows come sorted by run;
a block holds whole runs and is bounded but for its longest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from posegrid.functions import manifold
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSE = list(manifold.POSE)
#: Rows of whole runs that are worked on at once; a longer run goes by itself.
BLOCK = 1 << 15
#: Poses of the longest run whose system is a dense matrix, and numbers that a stack of such matrices holds.
DENSE, STACK = 32, 1 << 22

Edges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def by_runs(sides: list[DataFrame], f: Callable[[int, list[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``f`` over blocks of whole runs: how many runs, and the rows of each side (which has a column ``run``).

    Within f, in and out, ``run`` is the number of the run in its block. Runs without rows in some of the sides come along.
    """
    kinds = {c.name: c.dataType for side in sides for c in side.schema if c.name != "run"}
    of_run = next(c.dataType for c in sides[0].schema if c.name == "run")

    def flat(i: int, side: DataFrame) -> DataFrame:
        # what a side doesn't have is no null, so that longs stay longs
        return side.select(
            F.lit(i).alias("_side"), F.col("run").isNull().alias("_none"), F.coalesce("run", F.lit(0).cast(of_run)).alias("run"), *[F.col(c) if c in side.columns else F.lit(0).cast(t).alias(c) for c, t in kinds.items()]
        )

    rows = flat(0, sides[0])
    for i, side in enumerate(sides[1:], 1):
        rows = rows.unionByName(flat(i, side))
    columns = [[c for c in side.columns if c != "run"] for side in sides]

    def block(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(parts, ignore_index=True)
        own, none, side = whole["run"].to_numpy(), whole["_none"].to_numpy(), whole["_side"].to_numpy()
        first = np.append(True, (own[1:] != own[:-1]) | (none[1:] != none[:-1]))
        whole["run"] = np.cumsum(first) - 1
        names = pd.Series(own[first], dtype="Int64").mask(none[first])
        for out in f(len(names), [whole.loc[side == i, ["run", *c]].reset_index(drop=True) for i, c in enumerate(columns)]):
            if len(out):
                yield out.assign(run=names.to_numpy()[out["run"].to_numpy(np.int64)] if none.any() else own[first][out["run"].to_numpy(np.int64)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            own, none = batch["run"].to_numpy(), batch["_none"].to_numpy()
            cut = int(np.argmax((own == own[-1]) & (none == none[-1])))
            if n + cut >= BLOCK and (cut or (held[-1]["run"].iloc[-1], held[-1]["_none"].iloc[-1]) != (own[0], none[0])):
                yield from block([*held, batch.iloc[:cut]])
                held, n, batch = [], 0, batch.iloc[cut:]
            held.append(batch)
            n += len(batch)
        if held:
            yield from block(held)

    return rows.repartition("_none", "run").sortWithinPartitions("_none", "run").mapInPandas(run, schema)


def places(nodes: pd.DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Of nodes in order of run: where each run starts, how long it is, and a look-up of (run, id) that gives the place in the run, or -1; of equal ids the last counts."""
    own, ids = nodes["run"].to_numpy(), np.unique(nodes["id"].to_numpy())
    size = np.bincount(own, minlength=count)
    starts = np.cumsum(size) - size
    code = own * max(len(ids), 1) + np.searchsorted(ids, nodes["id"].to_numpy())
    order = np.argsort(code, kind="stable")

    def find(runs: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.full(len(runs), -1)
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        wanted = runs * len(ids) + at
        row = np.maximum(np.searchsorted(code[order], wanted, "right") - 1, 0)
        return np.where((ids[at] == x) & (code[order][row] == wanted), order[row] - starts[runs], -1)

    return starts, size, find


def alike(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, runs) of runs of equal length, as many as a stack holds; longer ones than ``DENSE`` one by one."""
    for n in np.unique(size[size > 0]).tolist():
        runs = np.flatnonzero(size == n)
        many = max(1, STACK // (36 * n * n)) if n <= DENSE else 1
        for at in range(0, len(runs), many):
            yield n, runs[at : at + many]


def sums(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``v`` that share a place, for n places."""
    out = np.zeros((n, *v.shape[1:]))
    if len(at):
        order = np.argsort(at, kind="stable")
        sorted_ = at[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        out[sorted_[first]] = np.add.reduceat(v[order], first, axis=0)
    return out


def stacked(count: int, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, err: np.ndarray, ja: np.ndarray, jb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrices (count, 6n, 6n) and gradients (count, n, 6) of edges between poses a and b, numbered through all runs; w is their information."""
    wa, wb = w[:, None, None] * ja.transpose(0, 2, 1), w[:, None, None] * jb.transpose(0, 2, 1)
    ends = np.concatenate([a, b])
    h = np.zeros((count * n, n, 6, 6))
    h[np.arange(count * n), np.arange(count * n) % n] = sums(ends, np.concatenate([wa @ ja, wb @ jb]), count * n)
    g = sums(ends, np.concatenate([np.einsum("nij,nj->ni", wa, err), np.einsum("nij,nj->ni", wb, err)]), count * n)
    apart = a != b
    swap = (a > b)[:, None, None]
    off = wa @ jb
    low, high, off = np.minimum(a, b)[apart], np.maximum(a, b)[apart], np.where(swap, off.transpose(0, 2, 1), off)[apart]
    keys, where = np.unique(low * n + high % n, return_inverse=True)
    off = sums(where, off, len(keys))
    i, j = keys // n, keys % n
    h[i, j], h[i // n * n + j, i % n] = off, off.transpose(0, 2, 1)
    return h.reshape(count, n, n, 6, 6).transpose(0, 1, 3, 2, 4).reshape(count, 6 * n, 6 * n), g.reshape(count, n, 6)
