"""Locking of a geodetic datum: the first prefix of a run's fixes whose fit is well enough determined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .folds import in_order

COLUMNS = ("gx", "gy", "gz", "x", "y", "z", "speed")
OUT = "lock_id long, n long, yaw double, yaw_sigma double, tx double, ty double, tz double"


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull: what the span along any direction depends on."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1:
                a, b = out[-1] - out[-2], p - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


class Prefix:
    """Moments of all fixes so far, about the first one; which is all that the fit and its gates need, with the hull of the places."""

    def __init__(self) -> None:
        self.origin, self.last = None, None
        self.sums, self.way, self.moving, self.n = np.zeros(13), 0.0, 0, 0
        self.corners = np.zeros((0, 2))

    def lock(self, ids: np.ndarray, rows: np.ndarray, baseline: float, excitation: float, speed: float, fixes: int, sigma: float) -> tuple | None:
        """The lock at the first of ``rows`` (COLUMNS) that closes a good prefix; else None, and the rows are part of all later prefixes."""
        if self.origin is None:
            self.origin, self.last = rows[0, :6].copy(), rows[0, 3:6].copy()
        e, m = rows[:, :3] - self.origin[:3], rows[:, 3:6] - self.origin[3:]
        steps = np.linalg.norm(np.diff(np.concatenate([self.last[None], rows[:, 3:6]]), axis=0), axis=1)
        way = self.way + np.cumsum(steps)
        moving = self.moving + np.cumsum(rows[:, 6] > speed)
        n = self.n + np.arange(1, len(rows) + 1)
        # sums of e, m, the scatter of e, and the cross moments of m with e
        parts = np.concatenate([e, m, e[:, :1] ** 2, e[:, :1] * e[:, 1:2], e[:, 1:2] ** 2, (m[:, :2, None] * e[:, None, :2]).reshape(-1, 4)], axis=1)
        sums = self.sums + np.cumsum(parts, axis=0)
        me, mm = sums[:, :3] / n[:, None], sums[:, 3:6] / n[:, None]
        sxx, sxy, syy = sums[:, 6] - n * me[:, 0] ** 2, sums[:, 7] - n * me[:, 0] * me[:, 1], sums[:, 8] - n * me[:, 1] ** 2
        cross = (sums[:, 9:13].reshape(-1, 2, 2) - n[:, None, None] * mm[:, :2, None] * me[:, None, :2]).reshape(-1, 4)
        spread = np.maximum(sxx + syy, 0.0)
        with np.errstate(divide="ignore"):
            yaw_sigma = np.where(spread > 0, 1 / np.sqrt(spread), np.inf)
        axis = 0.5 * np.arctan2(2 * sxy, sxx - syy)
        able = np.flatnonzero((n >= 2) & (way > baseline) & (moving >= fixes) & (yaw_sigma < sigma))
        corners, at = self.corners, 0
        for i in able.tolist():
            corners, at = hull(np.concatenate([corners, e[at : i + 1, :2]])), i + 1
            if np.ptp(corners @ np.array([np.cos(axis[i]), np.sin(axis[i])])) > excitation:
                yaw = float(np.arctan2(cross[i, 2] - cross[i, 1], cross[i, 0] + cross[i, 3]))
                c, s = np.cos(yaw), np.sin(yaw)
                fe, fm = me[i] + self.origin[:3], mm[i] + self.origin[3:]
                return int(ids[i]), int(n[i]), yaw, float(yaw_sigma[i]), float(fm[0] - c * fe[0] + s * fe[1]), float(fm[1] - s * fe[0] - c * fe[1]), float(fm[2] - fe[2])
        self.corners, self.last = hull(np.concatenate([corners, e[at:, :2]])), rows[-1, 3:6].copy()
        self.sums, self.way, self.moving, self.n = sums[-1], float(way[-1]), int(moving[-1]), int(n[-1])
        return None


def datum_lock(fixes: DataFrame, keys: list[str], order: list[str], ident: str, baseline: float, excitation: float, speed: float, moving: int, yaw_sigma: float) -> DataFrame:
    """One row for each key that locks: keys, lock_id, n, yaw, yaw_sigma and translation of the map from the geodetic frame.

    ``fixes`` has keys, ``order``, ``ident``, the place by satellite (gx, gy, gz), by the map (x, y, z) and the speed. The lock
    falls on the first fix at which the way on the map is over ``baseline``, ``moving`` fixes are faster than ``speed``, the span
    along the fixes' main axis is over ``excitation`` and the yaw's deviation is below ``yaw_sigma``. Partitions are sorted and
    passed through once; a key's state is its moments and the hull of its fixes. Fixes with a missing value are left out.
    """
    rows = fixes.select(*dict.fromkeys([*keys, *order, ident, *COLUMNS])).dropna(subset=list(COLUMNS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    names = [*keys, *(c.split()[0] for c in OUT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, done = None, Prefix(), False
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COLUMNS], axis=1)
            ids, found = batch.column(ident).to_numpy(zero_copy_only=False), []
            edges = [i for i in range(len(owner)) if i == 0 or owner[i] != owner[i - 1]] + [len(owner)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if owner[s] != here:
                    here, state, done = owner[s], Prefix(), False
                lock = None if done else state.lock(ids[s:e], values[s:e], baseline, excitation, speed, moving, yaw_sigma)
                if lock:
                    done = True
                    found.append((s, lock))
            if found:
                at, locks = zip(*found, strict=True)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *(pa.array(c) for c in zip(*locks, strict=True))], names)

    return in_order(rows, keys, order).mapInArrow(run, f"{kinds}, {OUT}")
