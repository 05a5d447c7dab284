"""Ordered per-key operators: clamps, gaps, islands, throttles, selections and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregations import medians
from .folds import ewma, streamed_fold

col = F.col


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def monotonic_clamp(rows: DataFrame, by: list[str], order: list[str], stamp: str) -> DataFrame:
    """A stamp before the latest one becomes that, with clock_step set."""
    top = F.max(stamp).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("clamped", F.greatest(col(stamp), top)).withColumn("clock_step", F.coalesce(col(stamp) < top, F.lit(False)))


def gap_detect(rows: DataFrame, by: list[str], stamp: str, period: float, failed: float, factor: float = 2.5) -> DataFrame:
    """failed, dropout or ok by the gap to the row before."""
    gap = col(stamp) - F.lag(stamp).over(_w(by, [stamp, "event_id"]))
    return rows.withColumn("gap", gap).withColumn("state", F.when(col("gap") > failed, "failed").when(col("gap") > factor * period, "dropout").otherwise("ok"))


def rate_ewma(rows: DataFrame, by: list[str], stamp: str, alpha: float = 0.1, second: float = 1e6, bucket: int = 86_400_000_000 * 7) -> DataFrame:
    """Add rate: smoothed instantaneous rate, seeded by the first; equal stamps leave it as it is. ``bucket`` of ``stamp`` is folded in one task."""
    gap = col(stamp) - F.lag(stamp).over(_w(by, [stamp, "event_id"]))
    timed = rows.withColumn("inst", F.when(gap > 0, second / gap)).select(*by, stamp, "event_id", "inst")
    return ewma(timed, by, [stamp, "event_id"], col("inst"), alpha, F.floor(col(stamp) / bucket), ["event_id"], "rate")


def rate_band(rates: DataFrame, nominal: float, width: float = 0.2) -> DataFrame:
    return rates.withColumn("band", F.when(col("rate") < nominal * (1 - width), "low").when(col("rate") > nominal * (1 + width), "high").otherwise("ok"))


def level_transition(rows: DataFrame, by: list[str], order: list[str], level: str) -> DataFrame:
    """Rows where the level differs from the one before; the first counts as a change from 0."""
    return rows.withColumn("before", F.coalesce(F.lag(level).over(_w(by, order)), F.lit(0))).filter(col(level) != col("before"))


def edge_throttle(rows: DataFrame, by: list[str], order: list[str], bad: Column) -> DataFrame:
    """Add emit (on entering a bad stretch) and streak (rows in it so far)."""
    w = _w(by, order)
    flagged = rows.withColumn("bad", bad)
    enter = col("bad") & ~F.coalesce(F.lag("bad").over(w), F.lit(False))
    island = flagged.withColumn("emit", enter).withColumn("island", F.sum(F.when(~col("bad") | col("emit"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn("streak", F.when(col("bad"), F.row_number().over(Window.partitionBy(*by, "island").orderBy(*order))).otherwise(0)).drop("island")


def rate_limit(rows: DataFrame, by: list[str], stamp: str, interval: int) -> DataFrame:
    """Rows at least ``interval`` after the last one let through; an interval of 0 or less lets all through."""
    if interval <= 0:
        return rows.select(*by, "event_id")
    return _apart(rows.select(*by, stamp, "event_id"), by, [stamp, "event_id"], stamp, interval)


def _apart(rows: DataFrame, by: list[str], order: list[str], at: str, least: int) -> DataFrame:
    """Rows whose ``at`` is ``least`` or more after that of the last one taken, the first one always; a null is passed over."""

    def step(s: dict, r: dict) -> dict:
        take = r[at] is not None and (s["last"] is None or r[at] - s["last"] >= least)
        return {"last": r[at] if take else s["last"], "take": take}

    return streamed_fold(rows, by, order, {"last": None, "take": False}, step, [order[-1]], "take boolean", "take").drop("take")


def spacing_decimate(poses: DataFrame, by: list[str], order: list[str], least: float) -> DataFrame:
    """Poses at which the way gone since the last one taken reaches ``least``; the way then starts anew."""
    w = _w(by, order)
    dx, dy = col("x") - F.lag("x").over(w), col("y") - F.lag("y").over(w)
    s = poses.select(*by, *order, F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("step"))

    def step(a: dict, r: dict) -> dict:
        way = (0.0 if a["take"] else a["way"]) + r["step"]
        return {"way": way, "take": way >= least}

    return streamed_fold(s, by, order, {"way": 0.0, "take": False}, step, ["kf_id"], "take boolean", "take").drop("take")


def keyframe_select(poses: DataFrame, by: list[str], order: list[str], distance: float, elapsed: int) -> DataFrame:
    """Poses far enough or long enough from the last keyframe, the first one always; poses with a null are passed over."""

    def step(s: dict, r: dict) -> dict:
        x, y, t = r["x"], r["y"], r["t"]
        if x is None or y is None or t is None:
            return s | {"take": False}
        if s["kx"] is None or (x - s["kx"]) ** 2 + (y - s["ky"]) ** 2 >= distance * distance or t - s["kt"] >= elapsed:
            return {"kx": x, "ky": y, "kt": t, "take": True}
        return s | {"take": False}

    init = {"kx": None, "ky": None, "kt": None, "take": False}
    return streamed_fold(poses.select(*by, "t", "kf_id", "x", "y"), by, order, init, step, ["kf_id"], "take boolean", "take").drop("take")


def moved_set(poses: DataFrame, by: list[str], order: list[str], threshold: float) -> DataFrame:
    """Rows at first sight, or moved more than ``threshold`` from where they were last emitted; a null is passed over."""

    def step(s: dict, r: dict) -> dict:
        x, y = r["x"], r["y"]
        if x is None or y is None:
            return s | {"take": False}
        if s["kx"] is None or math.sqrt((x - s["kx"]) ** 2 + (y - s["ky"]) ** 2) > threshold:
            return {"kx": x, "ky": y, "take": True}
        return s | {"take": False}

    init = {"kx": None, "ky": None, "take": False}
    return streamed_fold(poses.select(*by, *order, "x", "y"), by, order, init, step, ["kf_id"], "take boolean", "take").drop("take")


def cooldown_select(rows: DataFrame, by: list[str], order: list[str], at: str, cooldown: int) -> DataFrame:
    """Greedy in order: a row is kept if it lies ``cooldown`` or more from all kept before; ``at`` ascends, so from the last one."""
    return _apart(rows.select(*dict.fromkeys([*by, at, *order])), by, order, at, cooldown)


def dedup_watermark(rows: DataFrame, by: list[str], order: list[str], stamp: str) -> DataFrame:
    """Rows later than all before them."""
    top = F.max(stamp).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_top", top).filter(col("_top").isNull() | (col(stamp) > col("_top"))).drop("_top")


def dedup_close_stamps(rows: DataFrame, by: list[str], stamp: str, least: int) -> DataFrame:
    gap = col(stamp) - F.lag(stamp).over(_w(by, [stamp, "event_id"]))
    return rows.withColumn("_gap", gap).filter(col("_gap").isNull() | (col("_gap") > least)).drop("_gap")


def run_disable(rows: DataFrame, by: list[str], order: list[str], bad: Column, n: int) -> DataFrame:
    """Add disabled: true from the n-th failure in a row on, for good."""
    t = edge_throttle(rows, by, order, bad)
    return t.withColumn("disabled", F.max(col("streak") >= n).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def accel_magnitude_kf(rows: DataFrame, by: list[str], order: list[str], value: str, jerk: float, noise: float) -> DataFrame:
    """Scalar Kalman filter of a magnitude: estimate and variance after each row that has one, Q = (jerk dt)^2 / 3."""

    def step(s: dict, r: dict) -> dict:
        if s["e"] is None:
            return {"e": r["v"], "p": float(noise)}
        p = s["p"] + jerk * r["dt"] * jerk * r["dt"] / 3
        k = p / (p + noise)
        return {"e": s["e"] + k * (r["v"] - s["e"]), "p": (1 - k) * p}

    dt = F.coalesce((col(order[0]) - F.lag(order[0]).over(_w(by, order))) / 3.6e9, F.lit(0.0))
    s = rows.select(*by, *order, col(value).alias("v"), dt.alias("dt"))
    return streamed_fold(s.filter("v is not null"), by, order, {"e": None, "p": 0.0}, step, [order[-1]], "e double, p double")


def clock_rls(pairs: DataFrame, by: list[str], order: list[str], forget: float = 0.995) -> DataFrame:
    """Recursive least squares of offset and skew: y = b0 + b1 u after each row (u, y)."""

    def step(s: dict, r: dict) -> dict:
        u = r["u"]
        g0, g1 = s["p00"] + s["p01"] * u, s["p01"] + s["p11"] * u
        den = forget + g0 + g1 * u
        k0, k1 = g0 / den, g1 / den
        err = r["y"] - s["b0"] - s["b1"] * u
        return {"b0": s["b0"] + k0 * err, "b1": s["b1"] + k1 * err, "p00": (s["p00"] - k0 * g0) / forget, "p01": (s["p01"] - k0 * g1) / forget, "p11": (s["p11"] - k1 * g1) / forget}

    init = {"b0": 0.0, "b1": 0.0, "p00": 1e6, "p01": 0.0, "p11": 1e4}
    state = ", ".join(f"{k} double" for k in init)
    return streamed_fold(pairs.filter("u is not null and y is not null"), by, order, init, step, [order[-1]], state)


def profile(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, smooth: int = 0) -> DataFrame:
    """Central differences (one-sided at the ends), smoothed by a box of 2 * smooth + 1 that counts missing rows as zero."""
    w = _w(by, order)
    v = rows.withColumn("_v", value)
    before, after = F.lag("_v").over(w), F.lead("_v").over(w)
    slope = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - col("_v")).when(after.isNull(), col("_v") - before).otherwise((after - before) / 2)
    out = v.withColumn(name, slope).drop("_v")
    return out.withColumn(name, F.sum(name).over(w.rowsBetween(-smooth, smooth)) / (2 * smooth + 1)) if smooth else out


def motion_segments(rows: DataFrame, by: list[str], order: list[str], moving: Column, stamp: str, least: float, place: tuple[str, str] = ("x", "y"), still: float = 0.05, turn_deg: float = 20.0) -> DataFrame:
    """Stretches of a run: by, segment (from 1), kind, start, end, n, heading.

    Stretches of equal motion shorter than ``least`` belong to the one before them, but for a run's first; then equal neighbours
    are one. A moving stretch is ``forward``, with the heading in degrees between its ends if they lie more than ``still``
    apart. A ``stationary`` one between two headings that differ by more than ``turn_deg`` is a ``turn``, with their difference.
    Two passes over windows; only rows of one run are sorted together.
    """
    w, s = _w(by, order), _w(by, ["_run"])
    changed = lambda flag, over: F.when(F.coalesce(F.lag(flag).over(over) != col(flag), F.lit(True)), 1).otherwise(0)
    whole = lambda over: over.rowsBetween(Window.unboundedPreceding, 0)
    m = rows.withColumn("_moving", F.coalesce(moving, F.lit(False))).withColumn("_new", changed("_moving", w)).withColumn("_run", F.sum("_new").over(whole(w)))
    at = F.struct(*order)
    spot = F.struct(*place)
    first = m.groupBy(*by, "_run").agg(F.first("_moving").alias("_moving"), F.min(stamp).alias("start"), F.max(stamp).alias("end"), F.count(F.lit(1)).alias("n"), F.min_by(spot, at).alias("_a"), F.max_by(spot, at).alias("_b"))
    # a short stretch takes over the motion of the last one that is kept
    kept = (col("_run") == 1) | (col("end") - col("start") >= least)
    label = F.last(F.when(kept, col("_moving")), True).over(whole(s))
    second = first.withColumn("_moving", label).withColumn("_new", changed("_moving", s)).withColumn("segment", F.sum("_new").over(whole(s)))
    joined = second.groupBy(*by, "segment").agg(
        F.first("_moving").alias("_moving"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.min_by("_a", "_run").alias("_a"), F.max_by("_b", "_run").alias("_b")
    )
    dx, dy = (col(f"_b.{c}") - col(f"_a.{c}") for c in place)
    heading = F.when(col("_moving") & (F.sqrt(dx * dx + dy * dy) > still), F.degrees(F.atan2(dy, dx)))
    g = _w(by, ["segment"])
    h = joined.withColumn("_h", heading).withColumn("_before", F.lag("_h").over(g)).withColumn("_after", F.lead("_h").over(g))
    turned = col("_after") - col("_before")
    far = F.abs(F.pmod(turned + 180, F.lit(360.0)) - 180) > turn_deg
    kind = F.when(col("_moving"), "forward").when(F.coalesce(far, F.lit(False)), "turn").otherwise("stationary")
    return h.withColumn("kind", kind).select(*by, "segment", "kind", "start", "end", "n", F.when(col("_moving"), col("_h")).when(col("kind") == "turn", turned).alias("heading"))


def spoof_run(rows: DataFrame, by: list[str], order: list[str], stamp: str, place: str, speed: str, keep: list[str], window: int, unit: int, most: float, persist: int, ring: int) -> DataFrame:
    """by, ``keep``, n and reject: how many fixes in a row disagree by over ``most`` with the reference velocity ``speed`` (per ``unit`` of the stamp).

    A fix's own velocity is that since the oldest of the last ``ring`` accepted ones that is ``window`` old at least. Agreement
    sets n to 0; a fix without such an old one or without a reference leaves it and is accepted; others are rejected from
    ``persist`` in a row on, and rejected ones aren't referred to later.
    """

    def step(s: dict, r: dict) -> dict:
        seen = next((e for e in s["ring"] if r[stamp] - e[0] >= window), None)
        n, reject = s["n"], False
        if seen is not None and r[speed] is not None and r[place] is not None:
            off = abs((r[place] - seen[1]) / ((r[stamp] - seen[0]) / unit) - r[speed])
            n = n + 1 if off > most else 0
            reject = n >= persist
        taken = s["ring"] if reject or r[place] is None else (*s["ring"], (r[stamp], r[place]))[-ring:]
        return {"ring": taken, "n": n, "reject": reject}

    slim = rows.select(*dict.fromkeys([*by, *order, stamp, place, speed, *keep]))
    return streamed_fold(slim, by, order, {"ring": (), "n": 0, "reject": False}, step, keep, "n bigint, reject boolean")


def onset_sustained(errors: DataFrame, by: list[str], order: list[str], value: str, floor: float, factor: float = 8.0) -> DataFrame:
    """First row whose error exceeds max(floor, factor * median of the first quarter) while the mean from there on does too."""
    w = _w(by, order)
    numbered = errors.withColumn("i", F.row_number().over(w)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    early = medians(numbered.filter(col("i") <= F.greatest(F.lit(1), F.floor(col("m") / 4))), by, value).select(*by, F.greatest(F.lit(floor), factor * col("median")).alias("limit"))
    rest = numbered.join(early, by).withColumn("ahead", F.avg(value).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return rest.filter((col(value) > col("limit")) & (col("ahead") > col("limit"))).groupBy(*by).agg(F.min_by(order[-1], F.struct(*order)).alias("onset"))


def sparse_profile(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n rows at evenly spaced places, first and last among them."""
    numbered = rows.withColumn("i", F.row_number().over(_w(by, order)) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (col("m") - 1) / (n - 1)))
    return numbered.filter(F.array_contains(places, col("i").cast("long"))).drop("i", "m")


def upstream_loss(rows: DataFrame, by: list[str], stamp: str, period: float) -> DataFrame:
    """Missed rows before each one, and their running share."""
    w = _w(by, [stamp, "event_id"])
    missed = F.greatest(F.lit(0), F.round((col(stamp) - F.lag(stamp).over(w)) / period).cast("long") - 1)
    m = rows.withColumn("missed", F.coalesce(missed, F.lit(0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lost, seen = F.sum("missed").over(run), F.count(F.lit(1)).over(run)
    return m.withColumn("share", lost / (lost + seen))
