"""Projections, validity filters and quality gates. Filters that reject add the first failing check as ``reason``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Validity:
    blind: float = 0.5
    det_range: float = 120.0
    intensity_gate: bool = False
    intensity_min: float = 0.0
    intensity_max: float = 255.0


def finite(*columns: str) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return good


def square_norm(*columns: str) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c) * F.col(c)
    return total


def lidar_validity_reason(cfg: Validity = Validity(), mask: Column | None = None) -> Column:
    """Ordered cascade; the first failing check wins: nonfinite, blind, range, selfhit, intensity, else ok."""
    r2 = square_norm("x", "y", "z")
    reason = F.when(~finite("x", "y", "z"), "nonfinite").when(r2 < cfg.blind**2, "blind").when(r2 > cfg.det_range**2, "range")
    if mask is not None:
        reason = reason.when(mask, "selfhit")
    if cfg.intensity_gate:
        reason = reason.when((F.col("intensity") < cfg.intensity_min) | (F.col("intensity") > cfg.intensity_max), "intensity")
    return reason.otherwise("ok")


def lidar_validity_filter(points: DataFrame, cfg: Validity = Validity(), mask: Column | None = None) -> DataFrame:
    return points.withColumn("reason", lidar_validity_reason(cfg, mask))


def decimate_nth_valid(points: DataFrame, n: int, cfg: Validity = Validity()) -> DataFrame:
    """Every n-th valid point of each scan; invalid ones don't count."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("idx"))
    return lidar_validity_filter(points, cfg).filter("reason = 'ok'").withColumn("nth", rank).filter(F.col("nth") % n == 0)


def nonfinite_drop(points: DataFrame, warn_ratio: float = 0.05) -> DataFrame:
    """Scans with their finite points: n_in, n_out, ratio dropped, warn, rejected (nothing left)."""
    good = F.count(F.when(finite("x", "y", "z"), 1))
    counted = points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_in"), good.alias("n_out"))
    ratio = 1 - F.col("n_out") / F.col("n_in")
    return counted.withColumn("ratio", ratio).withColumn("warn", ratio > warn_ratio).withColumn("rejected", F.col("n_out") == 0)


def reject_no_point_time(points: DataFrame) -> DataFrame:
    """Scans in which some point has a time offset."""
    return points.groupBy("scan_id").agg(F.bool_or(F.col("t_offset") != 0).alias("timed")).filter("timed").select("scan_id")


def reject_empty_scan(scans: DataFrame, points: DataFrame) -> DataFrame:
    """Scans that have a point."""
    return scans.join(points.select("scan_id"), "scan_id", "left_semi")


def imu_finite_filter(samples: DataFrame, *columns: str) -> DataFrame:
    return samples.filter(finite(*columns))


def selfhit_mask(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside any of the vehicle's boxes (min_x, ..., max_z): a small dimension that is broadcast."""
    inside = " and ".join(f"{c} between min_{c} and max_{c}" for c in "xyz")
    return points.join(F.broadcast(boxes), F.expr(inside), "left_semi")


def sensor_time_offset(samples: DataFrame, offsets: dict[int, int], stamp: str = "stamp_us") -> DataFrame:
    """Add each sensor's constant correction to its stamps."""
    shift = F.coalesce(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("sensor_id")], F.lit(0)) if offsets else F.lit(0)
    return samples.withColumn(stamp, F.col(stamp) + shift)


def stamp_ladder(samples: DataFrame) -> DataFrame:
    """Choose stamp and source by modality from device_us, host_us and locked."""
    device, host, locked = F.col("device_us"), F.col("host_us"), F.col("locked")
    source = (
        F.when(F.col("modality") == "lidar", F.when(locked, "HwPtp").otherwise("SwOffset"))
        .when(F.col("modality").isin("imu", "camera"), F.when(device.isNotNull(), "SwOffset").otherwise("ArrivalOnly"))
        .otherwise(F.when(locked, "HwPps").when(device.isNotNull(), "SwOffset").otherwise("ArrivalOnly"))
    )
    return samples.withColumn("source", source).withColumn("stamp_us", F.when(F.col("source") == "ArrivalOnly", host).otherwise(F.coalesce(device, host)))


def mid_exposure_shift(frames: DataFrame) -> DataFrame:
    """Shift a frame to the middle of its exposure; without an exposure it stays and is flagged."""
    half = F.round(F.col("exposure_s") / 2 * 1e6).cast("long")
    return frames.withColumn("no_exposure", ~(F.col("exposure_s") > 0)).withColumn("stamp_us", F.col("stamp_us") + F.when(F.col("exposure_s") > 0, half).otherwise(0))


def interval_end_shift(samples: DataFrame, shift_us: int) -> DataFrame:
    return samples.withColumn("stamp_us", F.col("stamp_us") + shift_us)


def range_crop(points: DataFrame, max_range: float) -> DataFrame:
    norm = F.sqrt(square_norm("x", "y", "z"))
    return points.withColumn("range", norm).filter((norm > 0) & (norm <= max_range))


def aabb_contains(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Points in a closed box."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside & F.col(c).between(a, b)
    return points.filter(inside)


def aabb_intersects(a: str, b: str) -> Column:
    """Whether two boxes (columns a_min_x, ..., b_max_z) meet; an empty box meets none."""
    out = F.lit(True)
    for c in "xyz":
        out = out & (F.col(f"{a}_min_{c}") <= F.col(f"{a}_max_{c}")) & (F.col(f"{b}_min_{c}") <= F.col(f"{b}_max_{c}"))
        out = out & (F.col(f"{a}_min_{c}") <= F.col(f"{b}_max_{c}")) & (F.col(f"{b}_min_{c}") <= F.col(f"{a}_max_{c}"))
    return out


def gnss_quality_gate(fixes: DataFrame, min_rank: int = 2, min_sats: int = 6, max_trace: float = 5.0) -> DataFrame:
    """Reason of the first failing check: rank, sats (0 counts as not reported), cov, else ok."""
    reason = F.when(F.col("fix_rank") < min_rank, "rank").when((F.col("num_sats") > 0) & (F.col("num_sats") < min_sats), "sats").when(F.col("cov_trace") > max_trace, "cov").otherwise("ok")
    return fixes.withColumn("reason", reason)


def gnss_backend_gate(fixes: DataFrame, k: float = 1.0, spacing: float = 1.0, max_trace: float = 5.0) -> DataFrame:
    """reject_quality, skip_confident (the graph knows better), skip_spacing or accept; needs marginal_trace and travelled."""
    decision = (
        F.when((F.col("fix_rank") == 0) | (F.col("cov_trace") > max_trace), "reject_quality")
        .when(F.col("cov_trace") >= k * k * F.col("marginal_trace"), "skip_confident")
        .when(F.col("travelled") < spacing, "skip_spacing")
        .otherwise("accept")
    )
    return fixes.withColumn("decision", decision)


def gnss_prelock_floor(fixes: DataFrame, max_trace: float = 5.0) -> DataFrame:
    return fixes.filter((F.col("fix_rank") > 0) & (F.col("cov_trace") <= max_trace))


def loop_fitness_floor(loops: DataFrame, least: float) -> DataFrame:
    """Accepted and rejected loops by run."""
    return loops.groupBy("run").agg(F.count(F.when(F.col("fitness") >= least, 1)).alias("n_accepted"), F.count(F.when(F.col("fitness") < least, 1)).alias("n_rejected"))


def telemetry_gate(rows: DataFrame, exact: dict[str, bool], prefixes: list[tuple[str, bool]], default: bool) -> DataFrame:
    """Enabled by exact key, else by the first registered prefix, else by the default."""
    out = F.lit(None).cast("boolean")
    for k, v in exact.items():
        out = F.coalesce(out, F.when(F.col("key") == k, F.lit(v)))
    for p, v in prefixes:
        out = F.coalesce(out, F.when(F.col("key").startswith(p), F.lit(v)))
    return rows.withColumn("enabled", F.coalesce(out, F.lit(default)))
