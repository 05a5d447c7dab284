"""Aggregations over voxels, polar cells, sweeps, stages and trajectories."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import in_order, streamed_fold
from .joins import cells
from .runs import BLOCK

VOXEL = ["cx", "cy", "cz"]


def voxel_first(points: DataFrame, edge: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first point of each cell in the given order."""
    other = [c for c in points.columns if c not in (by or [])]
    best = cells(points, edge).groupBy(*(by or []), *VOXEL).agg(F.min_by(F.struct(*other), F.struct(*order)).alias("p"))
    return best.select(*(by or []), *VOXEL, "p.*")


def voxel_centre_nearest(points: DataFrame, edge: float, by: list[str]) -> DataFrame:
    """The point of each cell nearest to its centre; ties go to the smaller time offset, then index."""
    c = cells(points, edge)
    d2 = sum(((F.col(a) - (F.col(f"c{a}") + 0.5) * edge) * (F.col(a) - (F.col(f"c{a}") + 0.5) * edge) for a in "xyz"), F.lit(0.0))
    best = c.withColumn("d2", F.round(d2, 9)).groupBy(*by, *VOXEL).agg(F.min(F.struct("d2", "t_offset", "idx")).alias("m"))
    return best.select(*by, *VOXEL, F.col("m.idx").alias("idx"), F.col("m.d2").alias("d2"))


def voxel_reservoir(points: DataFrame, edge: float, cap: int, seed: int, by: list[str]) -> DataFrame:
    """At most ``cap`` points of each cell, chosen by a seeded hash: the same whatever the order of rows or the partitions."""
    order = Window.partitionBy(*by, *VOXEL).orderBy(F.xxhash64(F.lit(seed), *by, "idx"), "idx")
    return cells(points, edge).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap).drop("r")


def voxel_mean(points: DataFrame, edge: float, max_range: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Mean position and count of each cell, points beyond max_range left out."""
    if max_range is not None:
        points = points.filter(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= max_range**2)
    return cells(points, edge).groupBy(*(by or []), *VOXEL).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count(F.lit(1)).alias("n"))


def voxel_insert_spaced(points: DataFrame, edge: float, cap: int, order: list[str]) -> DataFrame:
    """Points kept when inserted in order: a cell takes at most ``cap``, none nearer than edge / sqrt(cap) to one it has.

    The fold passes once through each cell's rows in order and holds at most ``cap`` points.
    """
    gap2 = edge * edge / cap

    def put(s: dict, p: dict) -> dict:
        kept = s["kept"]
        own = (p["x"], p["y"], p["z"])
        take = len(kept) < cap and all(sum((a - b) ** 2 for a, b in zip(q, own, strict=True)) >= gap2 for q in kept)
        return {"kept": (*kept, own) if take else kept, "take": take}

    rows = cells(points, edge)
    return streamed_fold(rows, VOXEL, order, {"kept": (), "take": False}, put, [*order, *[c for c in "xyz" if c not in order]], "take boolean", "take").drop("take")


def moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products: what plane fits and overlaps need, combined before the shuffle."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"], *[F.sum(F.col(p[0]) * F.col(p[1])).alias(f"s{p}") for p in pairs])


def plane_fit(points: DataFrame, edge: float, min_points: int = 5, flatness: float = 0.1) -> DataFrame:
    """Plane of each cell by principal components: normal, d, rms, planar, n. Moments are summed by Spark, eigenvalues taken in batches."""

    @F.pandas_udf("nx double, ny double, nz double, d double, rms double, planar boolean")
    def fit(n: pd.Series, sx: pd.Series, sy: pd.Series, sz: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([sx / n, sy / n, sz / n], axis=1)
        second = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3) / n.to_numpy()[:, None, None]
        value, vector = np.linalg.eigh(second - m[:, :, None] * m[:, None, :])
        normal = vector[:, :, 0]
        return pd.DataFrame(
            {"nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "d": -(normal * m).sum(1), "rms": np.sqrt(np.maximum(value[:, 0], 0)), "planar": value[:, 0] / np.maximum(value[:, 1], 1e-12) < flatness}
        )

    m = moments(cells(points, edge), VOXEL).filter(F.col("n") >= min_points)
    return m.select(*VOXEL, "n", fit("n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz").alias("f")).select(*VOXEL, "n", "f.*")


def tsdf_fuse(points: DataFrame, edge: float, shells: int, origin: tuple[float, float, float], most: float) -> DataFrame:
    """(cx, cy, cz, d, w): truncated signed distance of each cell near a point, averaged; w is capped at ``most``.

    Below the cap the running average is the mean, whatever the order, so it combines before the shuffle.
    """
    around = [F.lit(s) for s in range(-shells, shells + 1)]
    c = cells(points, edge)
    for a in "xyz":
        c = c.withColumn(f"s{a}", F.explode(F.array(*around)))
    c = c.withColumns({f"v{a}": F.col(f"c{a}") + F.col(f"s{a}") for a in "xyz"})
    centre = {a: (F.col(f"v{a}") + 0.5) * edge for a in "xyz"}
    dist = F.sqrt(sum(((F.col(a) - centre[a]) * (F.col(a) - centre[a]) for a in "xyz"), F.lit(0.0)))
    side = sum(((centre[a] - F.col(a)) * (F.lit(o) - F.col(a)) for a, o in zip("xyz", origin, strict=True)), F.lit(0.0))
    near = c.withColumn("dist", dist).filter(F.col("dist") <= shells * edge).withColumn("sdf", F.when(side >= 0, F.col("dist")).otherwise(-F.col("dist")))
    return near.groupBy(*[F.col(f"v{a}").alias(f"c{a}") for a in "xyz"]).agg(F.avg("sdf").alias("d"), F.least(F.count(F.lit(1)).cast("double"), F.lit(most)).alias("w"))


def normal_equations(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of J'J (upper triangle), J'r, squared residuals and n, with J = [I, -hat(p)]; p is (px, py, pz), the residual (rx, ry, rz)."""
    px, py, pz, rx, ry, rz = (F.col(c) for c in ("px", "py", "pz", "rx", "ry", "rz"))
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [[one, zero, zero, zero, pz, -py], [zero, one, zero, -pz, zero, px], [zero, zero, one, py, -px, zero]]
    r = [rx, ry, rz]
    out = [F.sum(sum((j[a] * j[b] for j in rows), F.lit(0.0))).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    out += [F.sum(sum((j[a] * v for j, v in zip(rows, r, strict=True)), F.lit(0.0))).alias(f"b{a}") for a in range(6)]
    return pairs.groupBy(*keys).agg(*out, F.sum(rx * rx + ry * ry + rz * rz).alias("chi2"), F.count(F.lit(1)).alias("n"))


TWO = ("xx", "yy", "zz", "xy", "xz", "yz")
#: Pairs of neighbours that are held at once.
NEIGHBOURS = 1 << 20


def _sums_around(own: np.ndarray, p: np.ndarray, radius: float) -> np.ndarray:
    """(points, 10): how many points of the same ``own`` (ascending) lie within radius of each, sums of what they lie off by, and of its products."""
    out = np.zeros((len(p), 10))
    rows = np.flatnonzero(np.isfinite(p).all(axis=1))
    if not len(rows):
        return out
    of, q = own[rows], p[rows]
    cell = np.floor(q / radius)
    # numbers of the cells that occur, apart by more than one where cells aren't neighbours
    ranks = []
    for axis in range(3):
        values, back = np.unique(cell[:, axis], return_inverse=True)
        ranks.append(np.cumsum(np.append(1, np.minimum(np.diff(values), 2)).astype(np.int64))[back])
    wide = [int(r.max()) + 2 for r in ranks]
    code = ((of * wide[0] + ranks[0]) * wide[1] + ranks[1]) * wide[2] + ranks[2]
    order = np.argsort(code, kind="stable")
    code, q, rows = code[order], q[order], rows[order]
    # cells that follow each other along z are one range
    low = code[:, None] + np.array([(i * wide[1] + j) * wide[2] - 1 for i in (-1, 0, 1) for j in (-1, 0, 1)])
    begin, end = np.searchsorted(code, low.ravel()), np.searchsorted(code, low.ravel() + 3)
    many = end - begin
    total, at = np.cumsum(many.reshape(-1, 9).sum(1)), 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + NEIGHBOURS, "right")))
        size = many[9 * at : 9 * to]
        near = np.repeat(begin[9 * at : 9 * to] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        centre = np.repeat(np.repeat(np.arange(at, to), 9), size)
        # about a neighbour of its own, so that sums of squares don't cancel far from the origin
        d = q[near] - q[centre]
        inside = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= radius * radius
        d, centre = d[inside], centre[inside] - at
        x, y, z = d.T
        for k, v in enumerate((None, x, y, z, x * x, y * y, z * z, x * y, x * z, y * z)):
            out[rows[at:to], k] = np.bincount(centre, v, to - at)
        at = to
    return out


def _first_of(rows: pa.RecordBatch, by: tuple[str, ...]) -> np.ndarray:
    """Which rows differ from the one before in ``by``; the first does."""
    out = np.ones(rows.num_rows, bool)
    out[1:] = False
    for c in by:
        now, before = rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)
        for differs in (pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null())):
            out[1:] |= differs.to_numpy(zero_copy_only=False)
    return out


def _normals(points: DataFrame, by: tuple[str, ...], radius: float, least: int) -> DataFrame:
    """``points`` (by, q, x, y, z) with v, the direction in which their neighbours scatter least, or null; see surface_normals."""
    names = ["n", *(f"s{a}" for a in "xyz"), *TWO]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    columns = [*by, "q", "x", "y", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block holds whole groups, since only the last group of a batch may go on
        held, n = [], 0
        key = lambda batch, i: [batch.column(c)[i].as_py() for c in by]
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(np.flatnonzero(_first_of(batch, by))[-1])
            if n + cut >= BLOCK and (cut or key(held[-1], held[-1].num_rows - 1) != key(batch, 0)):
                yield block([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        p = np.stack([rows.column(a).to_numpy(zero_copy_only=False).astype(float) for a in "xyz"], axis=1)
        found = _sums_around(np.cumsum(_first_of(rows, by)), p, radius)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *(pa.array(found[:, k]) for k in range(10))], [*columns, *names])

    rows = in_order(points.select(*columns), list(by), [])
    made = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + ", ".join(f"{c} double" for c in names))
    scatter = F.struct(*[(F.col(t) - F.col(f"s{t[0]}") * F.col(f"s{t[1]}") / F.col("n")).alias(t) for t in TWO])
    return made.select(*columns, F.when(F.col("n") >= least, least_direction(scatter)).alias("v"))


def surface_normals(points: DataFrame, by: tuple[str, ...], radius: float, least: int = 5) -> DataFrame:
    """by, q, nx, ny, nz: the direction in which the neighbours of each of ``points`` (by, q, x, y, z) scatter least.

    Neighbours are the points of the same ``by`` within ``radius``, itself included; groups go through in blocks, in which points meet
    in grid cells, and nothing but the points is shuffled. Points with fewer than ``least``, with neighbours on one line, or without a
    clear direction give no row. Eigenvalues come from the closed form for symmetric matrices, the direction from the largest cross
    product of two rows of what is left when the least one is taken off the diagonal; all by expressions.
    """
    return _normals(points, by, radius, least).filter("v is not null").select(*by, "q", *[F.col(f"v.{t}").alias(f"n{t}") for t in "xyz"])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: a lambda's variable isn't replaced by its expression, as a column of a projection is."""
    return F.element_at(F.transform(F.array(value), then), 1)


def least_direction(scatter: Column) -> Column:
    """(x, y, z) of length 1 along which a symmetric matrix (struct xx, yy, zz, xy, xz, yz) is least; null if it has rank one or less, or no clear direction."""

    def spread(m: Column) -> Column:
        mean = (m["xx"] + m["yy"] + m["zz"]) / 3
        d = [m[t] - mean for t in ("xx", "yy", "zz")]
        size = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])) / 6)
        return _let(F.struct(mean.alias("mean"), F.when(size > 0, size).alias("size")), lambda s: turned(m, s))

    def turned(m: Column, s: Column) -> Column:
        a, b, c = (m[t] - s["mean"] for t in ("xx", "yy", "zz"))
        e, f, g = m["xy"], m["xz"], m["yz"]
        det = (a * (b * c - g * g) - e * (e * c - g * f) + f * (e * g - b * f)) / (s["size"] * s["size"] * s["size"])
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
        return _let(angle, lambda t: values(m, s, t))

    def values(m: Column, s: Column, t: Column) -> Column:
        low, high = s["mean"] + 2 * s["size"] * F.cos(t + 2 * math.pi / 3), s["mean"] + 2 * s["size"] * F.cos(t)
        parts = F.struct(low.alias("low"), (3 * s["mean"] - low - high).alias("middle"), high.alias("high"))
        # nearer to a line than this the closed form can't tell
        return _let(parts, lambda v: F.when(v["middle"] > F.greatest(F.lit(1e-12), 1e-6 * v["high"]), crossed(m, s, v["low"])))

    def crossed(m: Column, s: Column, low: Column) -> Column:
        rows = [(m["xx"] - low, m["xy"], m["xz"]), (m["xy"], m["yy"] - low, m["yz"]), (m["xz"], m["yz"], m["zz"] - low)]
        products = []
        for u, v in ((0, 1), (0, 2), (1, 2)):
            p, q = rows[u], rows[v]
            products.append(F.struct((p[1] * q[2] - p[2] * q[1]).alias("x"), (p[2] * q[0] - p[0] * q[2]).alias("y"), (p[0] * q[1] - p[1] * q[0]).alias("z")))
        squared = F.transform(F.array(*products), lambda c: F.struct((c["x"] * c["x"] + c["y"] * c["y"] + c["z"] * c["z"]).alias("s"), c.alias("c")))
        clear = lambda w: F.when(w["s"] > F.pow(s["size"], F.lit(4.0)) * 1e-16, F.struct(*[(w["c"][t] / F.sqrt(w["s"])).alias(t) for t in "xyz"]))
        return _let(F.array_max(squared), clear)

    return _let(scatter, spread)


def observability_scores(points: DataFrame, by: tuple[str, ...], radius: float, least: int = 5, knee: float = 0.01) -> DataFrame:
    """by, n and s0 to s5 (translation, then rotation, about the axes): how much the surfaces around ``points`` (by, q, x, y, z) hold each direction.

    A row for each value of ``by`` that has points; n counts those with a normal, and without any all scores are 0.
    """
    p = _normals(points, by, radius, least).select("*", *[F.col(f"v.{t}").alias(f"n{t}") for t in "xyz"])
    x, y, z, nx, ny, nz = (F.col(c) for c in ("x", "y", "z", "nx", "ny", "nz"))
    row = (nx, ny, nz, y * nz - z * ny, z * nx - x * nz, x * ny - y * nx)
    h = p.groupBy(*by).agg(F.count("nx").alias("n"), *[F.coalesce(F.avg(v * v), F.lit(0.0)).alias(f"h{i}") for i, v in enumerate(row)])
    return h.select(*by, "n", *[(F.col(f"h{i}") / (F.col(f"h{i}") + knee)).alias(f"s{i}") for i in range(6)])


def imu_interval_stats(samples: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Mean rate, mean and variance of the force by sweep; one without samples holds the last rate, fewer than two have variance 1e9.

    samples: (sweep_id, w, f); sweeps: (run, sweep_id, t_begin).
    """
    own = samples.groupBy("sweep_id").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"), F.avg("f").alias("mean_f"), F.var_samp("f").alias("v"))
    joined = sweeps.join(own, "sweep_id", "left")
    held = F.last("mean_w", True).over(Window.partitionBy("run").orderBy("t_begin", "sweep_id").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("run", "sweep_id", F.coalesce("n", F.lit(0)).alias("n"), held.alias("mean_w"), "mean_f", F.when(F.coalesce("n", F.lit(0)) < 2, 1e9).otherwise(F.col("v")).alias("var_f"))


def bounds(points: DataFrame, keys: list[str], axes: str = "xyz") -> DataFrame:
    return points.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def validity_counts(reasons: DataFrame, keys: list[str]) -> DataFrame:
    """n_in, a count for each reason, n_out."""
    kinds = ("nonfinite", "blind", "range", "selfhit", "intensity")
    return reasons.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in"), *[F.count(F.when(F.col("reason") == k, 1)).alias(f"n_{k}") for k in kinds], F.count(F.when(F.col("reason") == "ok", 1)).alias("n_out"))


def stage_timing_stats(rows: DataFrame) -> DataFrame:
    """last, avg, max and count by stage."""
    return rows.groupBy("stage").agg(F.max_by("ms", "t").alias("last_ms"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), F.count(F.lit(1)).alias("n"))


def ate_stats(errors: DataFrame, keys: list[str]) -> DataFrame:
    """rmse, mean, median, max and the 95th percentile by axis of errors (ex, ey)."""
    e = errors.withColumn("e", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))).withColumn("ax", F.abs("ex")).withColumn("ay", F.abs("ey"))
    out = e.groupBy(*keys).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean"), F.max("e").alias("max"))
    for value, share, name in (("e", 0.5, "median"), ("ax", 0.95, "p95_x"), ("ay", 0.95, "p95_y")):
        out = out.join(quantiles(e, keys, value, share, name), keys, "left")
    return out.select(*keys, "rmse", "mean", "median", "max", "p95_x", "p95_y")


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float, name: str, accuracy: int = 1000) -> DataFrame:
    """keys and the exact quantile of ``value`` as ``name`` (between two rows by proportion), without holding a key's values anywhere.

    Keys of up to 1,000 * ``accuracy`` rows are ranked whole, in one sort by key and value. For larger ones
    approximate percentiles bracket the place; what lies below the bracket is only counted, and the few rows
    in it (about 4 / ``accuracy`` of all) are ranked. Null values and keys without any other are left out.
    """
    rows = rows.select(*keys, value).filter(F.col(value).isNotNull())
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1000 * accuracy).select(*keys)
    # one key in a million rows at most; as joins by sorting, all steps would hold their memory in one task together
    large = F.broadcast(large)
    one = Window.partitionBy(*keys)
    ranked = rows.join(large, keys, "left_anti").withColumn("_i", F.row_number().over(one.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(one))
    at = (F.col("_n") - 1) * F.lit(share)
    # the row at the place and the next one
    two = [F.max(F.when(F.col("_i") == place, F.col(value))) for place in (F.floor(at) + 1, F.least(F.floor(at) + 2, F.col("_n")))]
    small = ranked.groupBy(*keys).agg((two[0] + F.max(at - F.floor(at)) * (two[1] - two[0])).alias(name))
    return small.unionByName(_bracketed(rows.join(large, keys, "left_semi"), keys, value, share, name, accuracy))


def _bracketed(rows: DataFrame, keys: list[str], value: str, share: float, name: str, accuracy: int) -> DataFrame:
    """quantiles of keys with many rows."""
    ends = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
    about = rows.groupBy(*keys).agg(F.percentile_approx(value, ends, accuracy).alias("q"), F.count(F.lit(1)).alias("n"))
    bracket = about.select(*keys, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    near = rows.join(bracket, keys).filter(F.col(value) <= F.col("high"))
    below = near.groupBy(*keys).agg(F.count(F.when(F.col(value) < F.col("low"), 1)).alias("below"))
    inside = near.filter(F.col(value) >= F.col("low")).groupBy(*keys, "n", value).agg(F.count(F.lit(1)).alias("c")).join(below, keys)
    last = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    at = (F.col("n") - 1) * F.lit(share)
    # the row at the place and the next one
    two = [F.when((last >= place) & (last - F.col("c") < place), F.col(value)) for place in (F.floor(at) + 1, F.least(F.floor(at) + 2, F.col("n")))]
    found = inside.select(*keys, (at - F.floor(at)).alias("part"), two[0].alias("a"), two[1].alias("b"))
    return found.groupBy(*keys).agg((F.max("a") + F.max("part") * (F.max("b") - F.max("a"))).alias(name))


def medians(rows: DataFrame, keys: list[str], value: str, accuracy: int = 1000) -> DataFrame:
    """keys and the exact median of ``value``; see quantiles."""
    return quantiles(rows, keys, value, 0.5, "median", accuracy)


def planar_alignment(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Yaw and translation that best map (x, y) onto (gx, gy): closed form over sums, so it combines before the shuffle."""
    n = F.count(F.lit(1))
    s = {c: F.avg(c) for c in ("x", "y", "gx", "gy")}
    cross = F.avg(F.col("x") * F.col("gy") - F.col("y") * F.col("gx")) - (s["x"] * s["gy"] - s["y"] * s["gx"])
    same = F.avg(F.col("x") * F.col("gx") + F.col("y") * F.col("gy")) - (s["x"] * s["gx"] + s["y"] * s["gy"])
    out = pairs.groupBy(*keys).agg(n.alias("n"), F.atan2(cross, same).alias("yaw"), *[v.alias(f"m_{c}") for c, v in s.items()])
    c, si = F.cos("yaw"), F.sin("yaw")
    return out.select(*keys, "n", "yaw", (F.col("m_gx") - c * F.col("m_x") + si * F.col("m_y")).alias("tx"), (F.col("m_gy") - si * F.col("m_x") - c * F.col("m_y")).alias("ty"))


def umeyama_align(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rigid motion (no scale, no reflection) that best maps (x, y, z) onto (gx, gy, gz), for each key; sums by Spark, 3x3 decompositions in batches."""
    a, g = ("x", "y", "z"), ("gx", "gy", "gz")
    sums = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in (*a, *g)], *[F.sum(F.col(p) * F.col(q)).alias(f"s_{p}_{q}") for p in g for q in a])
    names = [*[f"s_{c}" for c in (*a, *g)], *[f"s_{p}_{q}" for p in g for q in a]]

    @F.pandas_udf("r array<double>, t array<double>")
    def solve(n: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        m = np.stack(cols, axis=1) / n.to_numpy()[:, None]
        ma, mg = m[:, :3], m[:, 3:6]
        cov = m[:, 6:].reshape(-1, 3, 3) - mg[:, :, None] * ma[:, None, :]
        u, _, vt = np.linalg.svd(cov)
        sign = np.ones((len(m), 3))
        sign[:, 2] = np.sign(np.linalg.det(u @ vt))
        r = (u * sign[:, None, :]) @ vt
        t = mg - np.einsum("nij,nj->ni", r, ma)
        return pd.DataFrame({"r": list(r.reshape(-1, 9)), "t": list(t)})

    return sums.select(*keys, "n", solve("n", *names).alias("f")).select(*keys, "n", "f.r", "f.t")


def range_image(points: DataFrame, rows: int, columns: int, low_deg: float, high_deg: float, keys: list[str]) -> DataFrame:
    """Least range by (elevation row, azimuth column)."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    el = F.degrees(F.asin(F.col("z") / r))
    az = F.degrees(F.atan2("y", "x"))
    az = F.when(az < 0, az + 360).otherwise(az)
    row, column = F.floor((el - low_deg) / (high_deg - low_deg) * rows), F.pmod(F.floor(az / 360 * columns), F.lit(columns))
    return points.withColumn("row", row).withColumn("col", column).withColumn("range", r).filter(F.col("row").between(0, rows - 1)).groupBy(*keys, "row", "col").agg(F.min("range").alias("range"))
