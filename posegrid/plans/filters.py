"""Queries of projections, filters and predicates."""

from __future__ import annotations

from posegrid import adapters as A
from posegrid.adapters import with_views
from posegrid.operators import filters as P
from pyspark.sql import functions as F

from .registry import Section, rounded

section = Section()
CFG = P.Validity(blind=10.0, det_range=60.0, intensity_gate=True, intensity_min=0.01, intensity_max=0.07)
REASON = "CASE WHEN x*x+y*y+z*z < 100 THEN 'blind' WHEN x*x+y*y+z*z > 3600 THEN 'range' WHEN intensity < 0.01 OR intensity > 0.07 THEN 'intensity' ELSE 'ok' END"


@section.add("lidar_validity_filter", with_views(f"SELECT scan_id, idx, {REASON} AS reason FROM v_point"))
def _(spark, d):
    return P.lidar_validity_filter(A.point(spark, d), CFG).select("scan_id", "idx", "reason")


@section.add("decimate_nth_valid", with_views(f"SELECT scan_id, idx FROM (SELECT scan_id, idx, row_number() OVER (PARTITION BY scan_id ORDER BY idx) AS n FROM v_point WHERE {REASON} = 'ok') WHERE n % 2 = 0"))
def _(spark, d):
    return P.decimate_nth_valid(A.point(spark, d), 2, CFG).select("scan_id", "idx")


ODD = "CASE WHEN idx % 5 = 0 THEN 'NaN'::DOUBLE ELSE x END"


@section.add("nonfinite_drop", with_views(f"SELECT scan_id, count(*) AS n_in, count(*) FILTER (NOT isnan({ODD})) AS n_out, round(1 - count(*) FILTER (NOT isnan({ODD})) / count(*), 6) + 0.0 AS ratio, 1 - count(*) FILTER (NOT isnan({ODD})) / count(*) > 0.05 AS warn, count(*) FILTER (NOT isnan({ODD})) = 0 AS rejected FROM v_point GROUP BY scan_id"))
def _(spark, d):
    return rounded(P.nonfinite_drop(A.point(spark, d).withColumn("x", F.when(F.col("idx") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("x")))))


@section.add("reject_no_point_time", with_views("SELECT scan_id FROM (SELECT scan_id, t_offset - 1 AS t FROM v_point) GROUP BY scan_id HAVING bool_or(t <> 0)"))
def _(spark, d):
    return P.reject_no_point_time(A.point(spark, d).withColumn("t_offset", F.col("t_offset") - 1))


@section.add("reject_empty_scan", with_views("SELECT o_orderkey AS scan_id FROM orders WHERE o_orderkey IN (SELECT scan_id FROM v_point WHERE x > 40)"))
def _(spark, d):
    return P.reject_empty_scan(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id")), A.point(spark, d).filter("x > 40"))


@section.add("imu_finite_filter", with_views("SELECT event_id FROM v_sensor WHERE modality = 'imu' AND k % 7 <> 0"))
def _(spark, d):
    odd = F.when(F.col("k") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return P.imu_finite_filter(A.modality(spark, d, "imu").withColumn("value", odd), "value").select("event_id")


@section.add("selfhit_mask", with_views("SELECT scan_id, idx FROM v_point WHERE (x BETWEEN 1 AND 10 AND y BETWEEN 0 AND 20 AND z BETWEEN 0 AND 5) OR (x BETWEEN 40 AND 50 AND y BETWEEN 10 AND 30 AND z BETWEEN 5 AND 9)"))
def _(spark, d):
    boxes = spark.createDataFrame([(1.0, 10.0, 0.0, 20.0, 0.0, 5.0), (40.0, 50.0, 10.0, 30.0, 5.0, 9.0)], "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    return P.selfhit_mask(A.point(spark, d), boxes).select("scan_id", "idx")


@section.add("sensor_time_offset", with_views("SELECT event_id, stamp_us + CASE sensor_id WHEN 1 THEN 5000 WHEN 2 THEN -2500 ELSE 0 END AS stamp_us FROM v_sensor"))
def _(spark, d):
    return P.sensor_time_offset(A.sensor(spark, d), {1: 5000, 2: -2500}).select("event_id", "stamp_us")


@section.add(
    "stamp_ladder",
    with_views("""SELECT event_id, CASE WHEN modality = 'lidar' THEN CASE WHEN locked THEN 'HwPtp' ELSE 'SwOffset' END WHEN modality IN ('imu', 'camera') THEN CASE WHEN device_us IS NOT NULL THEN 'SwOffset' ELSE 'ArrivalOnly' END
        WHEN locked THEN 'HwPps' WHEN device_us IS NOT NULL THEN 'SwOffset' ELSE 'ArrivalOnly' END AS source, coalesce(device_us, host_us) AS stamp_us
        FROM (SELECT event_id, modality, k % 2 = 0 AS locked, CASE WHEN k % 3 = 0 THEN NULL ELSE stamp_us END AS device_us, stamp_us + 1000 AS host_us FROM v_sensor)"""),
)
def _(spark, d):
    s = A.sensor(spark, d).withColumn("locked", F.col("k") % 2 == 0).withColumn("device_us", F.when(F.col("k") % 3 != 0, F.col("stamp_us"))).withColumn("host_us", F.col("stamp_us") + 1000)
    return P.stamp_ladder(s).select("event_id", "source", "stamp_us")


@section.add("mid_exposure_shift", with_views("SELECT event_id, NOT (e > 0) AS no_exposure, stamp_us + CASE WHEN e > 0 THEN CAST(round(e / 2 * 1e6) AS BIGINT) ELSE 0 END AS stamp_us FROM (SELECT event_id, stamp_us, (k % 4) / 128.0::DOUBLE AS e FROM v_sensor WHERE modality = 'camera')"))
def _(spark, d):
    return P.mid_exposure_shift(A.modality(spark, d, "camera").withColumn("exposure_s", (F.col("k") % 4) / 128.0)).select("event_id", "no_exposure", "stamp_us")


@section.add("interval_end_shift", with_views("SELECT event_id, stamp_us - 2500 AS stamp_us FROM v_sensor WHERE modality = 'imu'"))
def _(spark, d):
    return P.interval_end_shift(A.modality(spark, d, "imu"), -2500).select("event_id", "stamp_us")


@section.add("range_crop", with_views("SELECT scan_id, idx, round(sqrt(x*x+y*y+z*z), 6) AS range FROM v_point WHERE sqrt(x*x+y*y+z*z) > 0 AND sqrt(x*x+y*y+z*z) <= 45"))
def _(spark, d):
    return rounded(P.range_crop(A.point(spark, d), 45.0).select("scan_id", "idx", "range"))


@section.add("aabb_contains", with_views("SELECT scan_id, idx FROM v_point WHERE x BETWEEN 5 AND 25 AND y BETWEEN 10 AND 40 AND z BETWEEN 2 AND 7"))
def _(spark, d):
    return P.aabb_contains(A.point(spark, d), (5, 10, 2), (25, 40, 7)).select("scan_id", "idx")


@section.add(
    "aabb_intersects",
    with_views("SELECT scan_id, min(x) <= 30 AND max(x) >= 20 AND min(y) <= 30 AND max(y) >= 20 AND min(z) <= 6 AND max(z) >= 4 AS hit FROM v_point GROUP BY scan_id"),
)
def _(spark, d):
    boxes = A.point(spark, d).groupBy("scan_id").agg(*[f(c).alias(f"a_{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    for c, a, b in (("x", 20.0, 30.0), ("y", 20.0, 30.0), ("z", 4.0, 6.0)):
        boxes = boxes.withColumn(f"b_min_{c}", F.lit(a)).withColumn(f"b_max_{c}", F.lit(b))
    return boxes.select("scan_id", P.aabb_intersects("a", "b").alias("hit"))


@section.add("gnss_quality_gate", with_views("SELECT id, CASE WHEN fix_rank < 2 THEN 'rank' WHEN num_sats > 0 AND num_sats < 6 THEN 'sats' WHEN cov_trace > 5 THEN 'cov' ELSE 'ok' END AS reason FROM v_geo"))
def _(spark, d):
    return P.gnss_quality_gate(A.geo(spark, d)).select("id", "reason")


@section.add("gnss_backend_gate", with_views("SELECT id, CASE WHEN fix_rank = 0 OR cov_trace > 5 THEN 'reject_quality' WHEN cov_trace >= 2.25 * (id % 4) THEN 'skip_confident' WHEN id % 3 < 1 THEN 'skip_spacing' ELSE 'accept' END AS decision FROM v_geo"))
def _(spark, d):
    g = A.geo(spark, d).withColumn("marginal_trace", (F.col("id") % 4).cast("double")).withColumn("travelled", (F.col("id") % 3).cast("double"))
    return P.gnss_backend_gate(g, k=1.5).select("id", "decision")


@section.add("gnss_prelock_floor", with_views("SELECT id FROM v_geo WHERE fix_rank > 0 AND cov_trace <= 5"))
def _(spark, d):
    return P.gnss_prelock_floor(A.geo(spark, d)).select("id")


@section.add("loop_fitness_floor", with_views("SELECT run, count(*) FILTER (x / 500 >= 0.3) AS n_accepted, count(*) FILTER (x / 500 < 0.3) AS n_rejected FROM v_track GROUP BY run"))
def _(spark, d):
    return P.loop_fitness_floor(A.track(spark, d).withColumn("fitness", F.col("x") / 500), 0.3)


@section.add("telemetry_gate", "SELECT event_id, CASE event_type WHEN 'click' THEN true ELSE CASE WHEN event_type LIKE 's%' THEN false WHEN event_type LIKE 'v%' THEN true ELSE false END END AS enabled FROM events")
def _(spark, d):
    return P.telemetry_gate(A.table(spark, d, "events").withColumn("key", F.col("event_type")), {"click": True}, [("s", False), ("v", True)], False).select("event_id", "enabled")
