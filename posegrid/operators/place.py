"""Place recognition: polar scan descriptors, their keys, retrieval and comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from posegrid.functions.geometry import azimuth_deg, circshift, dot
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES, BLOCK_PLACES = 2048, 16_384


def scan_context(points: DataFrame, rings: int, sectors: int, max_range: float, lift: float = 2.0) -> DataFrame:
    """(scan_id, d): highest lifted point of each polar cell, row by row; empty cells are 0."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    near = points.withColumn("r", r).filter((F.col("r") <= max_range) & (F.col("r") >= 1e-6))
    place = lambda v, n: F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(v).cast("int")))
    cell = (place(F.col("r") / max_range * rings, rings) - 1) * sectors + place(azimuth_deg(F.col("x"), F.col("y")) / 360 * sectors, sectors) - 1
    cells = near.groupBy("scan_id", cell.alias("cell")).agg(F.max(F.col("z") + lift).alias("h"))
    grid = cells.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "h"))).alias("m"))
    return grid.select("scan_id", F.transform(F.sequence(F.lit(0), F.lit(rings * sectors - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("d"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def ring_keys(descriptors: DataFrame, rings: int, sectors: int) -> DataFrame:
    """Add ring (means of rows) and sector (means of columns); zeros count."""
    ring = F.transform(F.sequence(F.lit(0), F.lit(rings - 1)), lambda i: _sum(F.slice("d", i * sectors + 1, F.lit(sectors))) / sectors)
    column = F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda j: _sum(F.transform(F.sequence(F.lit(0), F.lit(rings - 1)), lambda i: F.element_at("d", i * sectors + j + 1))) / rings)
    return descriptors.withColumn("ring", ring).withColumn("sector", column)


def ring_key_knn(queries: DataFrame, places: DataFrame, k: int, min_gap: int = 1) -> DataFrame:
    """(q, id, d2, rank): the k earlier places (at least ``min_gap`` numbers before) whose ring keys are nearest; ties go to the smaller id.

    Queries and places meet in blocks of bounded size; each pair of blocks is one small matrix product's work and hands on
    k rows a query, which are then merged. Nothing is broadcast.
    """
    counted = [df.agg(F.count(F.lit(1)).alias("n")).first()["n"] for df in (queries, places)]
    parts = [max(1, -(-n // size)) for n, size in zip(counted, (BLOCK_QUERIES, BLOCK_PLACES), strict=True)]

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select("id", "ring", block.alias(names[0])).select("id", "ring", names[0], every.alias(names[1])).select("id", "ring", "_q", "_p")

    def nearest(keys: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p = p.sort_values("id")
            ids, rings = p["id"].to_numpy(), np.stack(p["ring"].to_numpy())
            for name, ring in zip(q["id"], q["ring"], strict=True):
                d2 = np.zeros(len(ids))
                for axis in range(len(ring)):
                    d2 += (ring[axis] - rings[:, axis]) ** 2
                d2 = np.round(d2, 9)
                able = np.flatnonzero(ids <= name - min_gap)
                best = able[np.argsort(d2[able], kind="stable")[:k]]
                out += [(name, int(ids[i]), float(d2[i])) for i in best]
        return pd.DataFrame(out, columns=["q", "id", "d2"])

    left = dealt(queries, parts[0], parts[1], ("_q", "_p"))
    right = dealt(places.select(*[F.col(c).alias(c) for c in places.columns]), parts[1], parts[0], ("_p", "_q"))
    pairs = left.groupBy("_q", "_p").cogroup(right.groupBy("_q", "_p")).applyInPandas(nearest, "q long, id long, d2 double")
    order = Window.partitionBy("q").orderBy("d2", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def column_cosine_distance(a: Column, b: Column, rings: int, sectors: int) -> Column:
    """Mean cosine distance of the columns that are non-zero in both; 1 if there is none. a and b are lists of rows."""

    def column(m: Column, j: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(rings - 1)), lambda i: F.element_at(m, i * sectors + j + 1))

    def one(j: Column) -> Column:
        x, y = column(a, j), column(b, j)
        n = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(n > 0, 1 - dot(x, y) / n)

    each = F.filter(F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), one), lambda v: v.isNotNull())
    return F.when(F.size(each) == 0, F.lit(1.0)).otherwise(_sum(each) / F.size(each))


def _added(parts) -> np.ndarray:
    """Sums in the order of parts, as Columns make them."""
    out = 0.0
    for v in parts:
        out = out + v
    return out


def sc_distance(pairs: DataFrame, rings: int, sectors: int, band: int) -> DataFrame:
    """Add shift and distance: the best rotation of b within ``band`` of the one that aligns the sector keys. pairs: q, id, a, b.

    Sums of all pairs of a batch are made together; distances are those of :func:`column_cosine_distance`, null where a descriptor is.
    """
    grid = lambda d: np.stack(d.to_numpy()).astype(float).reshape(-1, rings, sectors) if len(d) else np.zeros((0, rings, sectors))

    @F.pandas_udf("array<double>")
    def keys_apart(a: pd.Series, b: pd.Series) -> pd.Series:
        ka, kb = (_added(g[:, i] for i in range(rings)) / rings for g in (grid(a), grid(b)))
        out = np.stack([_added(((ka - np.roll(kb, s, axis=1)) ** 2)[:, j] for j in range(sectors)) for s in range(sectors)], axis=1)
        return pd.Series(list(out))

    @F.pandas_udf("array<double>")
    def distances(a: pd.Series, b: pd.Series, shifts: pd.Series) -> pd.Series:
        x, b, turns = grid(a), grid(b), np.stack(shifts.to_numpy()) if len(shifts) else np.zeros((0, 1), int)
        out = np.zeros(turns.shape)
        for t in range(turns.shape[1]):
            y = np.take_along_axis(b, ((np.arange(sectors) - turns[:, t : t + 1]) % sectors)[:, None, :], axis=2)
            dot = lambda u, v: _added(u[:, i] * v[:, i] for i in range(rings))
            n = np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))
            some = n > 0
            each = np.where(some, 1 - dot(x, y) / np.where(some, n, 1.0), 0.0)
            count = some.sum(1)
            out[:, t] = np.where(count > 0, _added(each[:, j] for j in range(sectors)) / np.maximum(count, 1), 1.0)
        return pd.Series(list(out))

    empty = F.array_repeat(F.lit(0.0), rings * sectors)
    a, b, known = F.coalesce("a", empty), F.coalesce("b", empty), F.col("a").isNotNull() & F.col("b").isNotNull()
    coarse = F.array_min(F.transform("_apart", lambda v, s: F.struct(F.round(v, 9).alias("v"), s.alias("s"))))["s"]
    # all rotations of a pair are tried on its row, so nothing is shuffled; a band may come round
    shifts = F.transform(F.sequence(F.lit(-band), F.lit(band)), lambda t: F.pmod(F.col("coarse") + t, F.lit(sectors)))
    keyed = pairs.withColumn("_apart", keys_apart(a, b)).withColumn("coarse", coarse).withColumn("_shifts", shifts).withColumn("_far", distances(a, b, "_shifts"))
    best = F.array_min(F.zip_with("_far", "_shifts", lambda v, s: F.struct(F.round(v, 9).alias("distance"), s.alias("shift"))))
    return keyed.select("q", "id", best.alias("m"), known.alias("_known")).select("q", "id", F.col("m.shift").alias("shift"), F.when(F.col("_known"), F.col("m.distance")).alias("distance"))


def topk_candidates(scored: DataFrame, k: int, threshold: float) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "id")
    return scored.filter(F.col("distance") < threshold).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def submap_window(poses: DataFrame, n: int, by: list[str], order: list[str], ident: str) -> DataFrame:
    """Add ids: the last n of the run up to each anchor."""
    return poses.withColumn("ids", F.collect_list(ident).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)))
