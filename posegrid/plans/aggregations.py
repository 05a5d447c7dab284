"""Queries of aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from posegrid import adapters as A
from posegrid.adapters import with_views
from posegrid.operators import aggregations as G
from posegrid.operators import filters, folds, place
from pyspark.sql import Window
from pyspark.sql import functions as F

from .filters import CFG, REASON
from .joins import GRID, NEAREST, PAIRS, _queries_targets
from .registry import Section, rounded

section = Section()
C4 = "CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(y / 4) AS BIGINT) AS cy, CAST(floor(z / 4) AS BIGINT) AS cz"


@section.add("voxel_first", with_views(f"SELECT cx, cy, cz, scan_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY scan_id, idx) AS n FROM (SELECT *, {C4} FROM v_point)) WHERE n = 1"))
def _(spark, d):
    return G.voxel_first(A.point(spark, d), 4.0, ["scan_id", "idx"]).select("cx", "cy", "cz", "scan_id", "idx")


@section.add("voxel_centre_nearest", with_views(f"SELECT scan_id, cx, cy, cz, idx, round(d2 + 1e-9, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, cx, cy, cz ORDER BY d2, t_offset, idx) AS n FROM (SELECT *, round(pow(x-(cx+0.5)*4,2)+pow(y-(cy+0.5)*4,2)+pow(z-(cz+0.5)*4,2), 9) AS d2 FROM (SELECT *, {C4} FROM v_point))) WHERE n = 1"))
def _(spark, d):
    return rounded(G.voxel_centre_nearest(A.point(spark, d), 4.0, ["scan_id"]).withColumn("d2", F.col("d2") + 1e-9))


@section.add("voxel_reservoir")
def _(spark, d):
    return G.voxel_reservoir(A.point(spark, d), 10.0, 3, 42, ["scan_id"]).select("scan_id", "idx", *G.VOXEL)


@section.add("plane_voxel_reservoir")
def _(spark, d):
    return G.voxel_reservoir(A.point(spark, d).withColumn("map", F.lit(0)).withColumn("idx", F.col("scan_id") * 100 + F.col("idx")), 10.0, 20, 7, ["map"]).select("idx", *G.VOXEL)


@section.add("voxel_mean", with_views("SELECT cx, cy, cz, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, count(*) AS n FROM (SELECT *, " + C4 + " FROM v_point WHERE x*x+y*y+z*z <= 2500) GROUP BY 1, 2, 3"))
def _(spark, d):
    return rounded(G.voxel_mean(A.point(spark, d), 4.0, 50.0))


@section.add("voxel_centroids", with_views("SELECT scan_id, cx, cy, cz, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, count(*) AS n FROM (SELECT *, " + C4 + " FROM v_point) GROUP BY 1, 2, 3, 4"))
def _(spark, d):
    return rounded(G.voxel_mean(A.point(spark, d), 4.0, by=["scan_id"]))


@section.add("voxel_insert_spaced")
def _(spark, d):
    return rounded(G.voxel_insert_spaced(A.point(spark, d), 5.0, 4, ["scan_id", "idx"]))


@section.add("plane_fit")
def _(spark, d):
    return rounded(G.plane_fit(A.point(spark, d), 10.0))


CELL = "greatest(1, least(8, CAST(ceil(sqrt(x*x+y*y)/60*8) AS INT))) AS ring, greatest(1, least(8, CAST(ceil((CASE WHEN degrees(atan2(y,x)) < 0 THEN degrees(atan2(y,x)) + 360 ELSE degrees(atan2(y,x)) END)/360*8) AS INT))) AS sector"


@section.add("scan_context", with_views(f"SELECT scan_id, i AS cell, round(coalesce(max(z + 2), 0), 6) AS h FROM (SELECT DISTINCT scan_id FROM v_point WHERE sqrt(x*x+y*y) BETWEEN 1e-6 AND 60) CROSS JOIN (SELECT unnest(range(0, 64)) AS i) LEFT JOIN (SELECT scan_id, z, {CELL} FROM v_point WHERE sqrt(x*x+y*y) BETWEEN 1e-6 AND 60) p USING (scan_id) WHERE p.z IS NULL OR (ring - 1) * 8 + sector - 1 = i GROUP BY 1, 2 HAVING count(p.z) > 0"))
def _(spark, d):
    s = place.scan_context(A.point(spark, d), 8, 8, 60.0)
    return rounded(s.select("scan_id", F.posexplode("d").alias("cell", "h")).filter("h <> 0"))


RING = "SELECT id, i AS ring, round(list_sum(d[i*8+1:i*8+8]) / 8, 6) + 0.0 AS v FROM v_descriptor, (SELECT unnest(range(0, 8)) AS i)"
SECTOR = "SELECT id, j AS sector, round(list_sum(list_transform(range(0, 8), lambda i: d[i*8+j+1])) / 8, 6) + 0.0 AS v FROM v_descriptor, (SELECT unnest(range(0, 8)) AS j)"


@section.add("ring_key", with_views(RING))
def _(spark, d):
    return rounded(place.ring_keys(A.descriptor(spark, d), 8, 8).select("id", F.posexplode("ring").alias("ring", "v")))


@section.add("sector_key", with_views(SECTOR))
def _(spark, d):
    return rounded(place.ring_keys(A.descriptor(spark, d), 8, 8).select("id", F.posexplode("sector").alias("sector", "v")))


@section.add(
    "tsdf_fuse",
    with_views("""SELECT cx, cy, cz, round(avg(CASE WHEN side >= 0 THEN dist ELSE -dist END), 6) + 0.0 AS d, least(count(*), 64.0::DOUBLE) AS w FROM (SELECT cx, cy, cz, sqrt(pow(x-(cx+0.5)*8,2)+pow(y-(cy+0.5)*8,2)+pow(z-(cz+0.5)*8,2)) AS dist, ((cx+0.5)*8-x)*(0-x)+((cy+0.5)*8-y)*(0-y)+((cz+0.5)*8-z)*(-50-z) AS side
        FROM (SELECT x, y, z, CAST(floor(x/8) AS BIGINT)+i AS cx, CAST(floor(y/8) AS BIGINT)+j AS cy, CAST(floor(z/8) AS BIGINT)+k AS cz FROM v_point, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), (SELECT unnest([-1,0,1]) AS k))) WHERE dist <= 8 GROUP BY 1, 2, 3"""),
)
def _(spark, d):
    return rounded(G.tsdf_fuse(A.point(spark, d), 8.0, 1, (0.0, 0.0, -50.0), 64.0))


COLOUR = dict(init={"c": "CAST(NULL AS DOUBLE)", "w": "0.0::DOUBLE"}, step={"c": "CASE WHEN f.w = 0 THEN b.v ELSE 0.8 * f.c + 0.2 * b.v END", "w": "least(f.w + 1, 8.0)"})


@section.add("colour_fuse", None)
def _(spark, d):
    p = A.point(spark, d).select(F.floor(F.col("x") / 5).cast("long").alias("cell"), "scan_id", "idx", F.pow(F.col("z") / 10, F.lit(2.2)).alias("v"))
    colour = folds.last_ewma(p, ["cell"], ["scan_id", "idx"], F.col("v"), 0.2, F.floor(F.col("scan_id") / 100), "c")
    weight = p.groupBy("cell").agg(F.least(F.count(F.lit(1)).cast("double"), F.lit(8.0)).alias("w"))
    return rounded(colour.join(weight, "cell"))


sql, ctes = folds.fold_sql("(SELECT CAST(floor(x / 5) AS BIGINT) AS cell, scan_id * 100 + idx AS seq, pow(z / 10, 2.2) AS v FROM v_point)", "cell", "seq", COLOUR["init"], COLOUR["step"], ["seq"], "SELECT cell, round(arg_max(c, seq), 6) + 0.0 AS c, arg_max(w, seq) AS w FROM o GROUP BY cell")
section.sql["colour_fuse"] = with_views(sql, *ctes, recursive=True)


@section.add("imu_interval_stats", with_views("SELECT run, sweep_id, n, round(last_value(mean_w IGNORE NULLS) OVER (PARTITION BY run ORDER BY t, sweep_id), 6) + 0.0 AS mean_w, round(mean_f, 6) AS mean_f, round(CASE WHEN n < 2 THEN 1e9 ELSE v END, 6) AS var_f FROM (SELECT t.run, t.kf_id AS sweep_id, t.t, count(p.x) AS n, avg(p.intensity) AS mean_w, avg(p.x) AS mean_f, var_samp(p.x) AS v FROM v_track t LEFT JOIN v_point p ON p.scan_id = t.kf_id GROUP BY 1, 2, 3)"))
def _(spark, d):
    s = A.point(spark, d).select(F.col("scan_id").alias("sweep_id"), F.col("intensity").alias("w"), F.col("x").alias("f"))
    return rounded(G.imu_interval_stats(s, A.track(spark, d).select("run", F.col("kf_id").alias("sweep_id"), F.col("t").alias("t_begin"))))


@section.add("static_init", with_views("SELECT run, count(*) AS n, round(atan2(avg(y), avg(x)), 6) AS tilt, round(avg(x), 6) AS bias_x, round(sqrt(pow(avg(x),2)+pow(avg(y),2)) - 9.81, 6) AS residual FROM (SELECT *, min(t) OVER (PARTITION BY run) AS t0 FROM v_track) WHERE t <= t0 + 86400000000 * 200 GROUP BY run"))
def _(spark, d):
    t = A.track(spark, d)
    start = t.groupBy("run").agg(F.min("t").alias("t0"))
    still = t.join(start, "run").filter(F.col("t") <= F.col("t0") + 86_400_000_000 * 200)
    x, y = F.avg("x"), F.avg("y")
    return rounded(still.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.atan2(y, x).alias("tilt"), x.alias("bias_x"), (F.sqrt(x * x + y * y) - 9.81).alias("residual")))


@section.add("normal_equations", with_views("SELECT scan_id, count(*) AS n, count(*)::DOUBLE AS h00, round(sum(z), 6) + 0.0 AS h04, round(sum(y*y+z*z), 6) AS h33, round(sum(-x*y), 6) + 0.0 AS h34, round(sum(intensity), 6) AS b0, round(sum(-z*0.5 + y*0.25), 6) + 0.0 AS b3, round(sum(intensity*intensity + 0.3125), 6) AS chi2 FROM v_point GROUP BY 1"))
def _(spark, d):
    p = A.point(spark, d).select("scan_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("intensity").alias("rx"), F.lit(0.5).alias("ry"), F.lit(0.25).alias("rz"))
    g = G.normal_equations(p, ["scan_id"])
    return rounded(g.select("scan_id", "n", "h00", "h04", "h33", "h34", "b0", "b3", "chi2"))


@section.add("cloud_bounds", with_views("SELECT scan_id, min(x) AS min_x, max(x) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM v_point GROUP BY 1"))
def _(spark, d):
    return rounded(G.bounds(A.point(spark, d), ["scan_id"]))


@section.add("dirty_bounds", with_views(f"SELECT scan_id % 16 AS owner, min(cx) AS min_cx, max(cx) AS max_cx, min(cy) AS min_cy, max(cy) AS max_cy FROM (SELECT scan_id, {C4} FROM v_point) GROUP BY 1"))
def _(spark, d):
    c = G.cells(A.point(spark, d), 4.0).withColumn("owner", F.col("scan_id") % 16)
    return c.groupBy("owner").agg(F.min("cx").alias("min_cx"), F.max("cx").alias("max_cx"), F.min("cy").alias("min_cy"), F.max("cy").alias("max_cy"))


@section.add("sweep_duration", with_views("SELECT scan_id, round(greatest(max(t_offset), least(0.8 * 5, max(t_offset) + 1.0)), 6) AS duration FROM v_point GROUP BY 1"))
def _(spark, d):
    end = F.max("t_offset")
    return rounded(A.point(spark, d).groupBy("scan_id").agg(F.greatest(end.cast("double"), F.least(F.lit(0.8 * 5), end + 1.0)).alias("duration")))


@section.add("validity_counts", with_views("SELECT scan_id, count(*) AS n_in, " + ", ".join(f"count(*) FILTER (r = '{k}') AS n_{k}" for k in ("nonfinite", "blind", "range", "selfhit", "intensity")) + f", count(*) FILTER (r = 'ok') AS n_out FROM (SELECT scan_id, {REASON} AS r FROM v_point) GROUP BY 1"))
def _(spark, d):
    return G.validity_counts(filters.lidar_validity_filter(A.point(spark, d), CFG), ["scan_id"])


def stages(spark, d):
    return A.sensor(spark, d).select(F.col("modality").alias("stage"), F.col("value").alias("ms"), F.col("stamp_us").alias("t"), "sensor_id", "event_id", "k")


@section.add("stage_timing_stats", with_views("SELECT modality AS stage, round(arg_max(value, stamp_us), 6) AS last_ms, round(avg(value), 6) AS avg_ms, round(max(value), 6) AS max_ms, count(*) AS n FROM v_sensor GROUP BY 1"))
def _(spark, d):
    return rounded(G.stage_timing_stats(stages(spark, d)))


@section.add("stage_timing_ewma")
def _(spark, d):
    s = stages(spark, d).withColumn("run", F.concat_ws("-", "stage", "sensor_id"))
    out = folds.ewma(s.select("run", "t", "ms", "event_id"), ["run"], ["t", "event_id"], F.col("ms"), 0.1, F.floor(F.col("t") / 604_800_000_000), ["event_id"], "e")
    return rounded(out.select("event_id", (F.col("e") + 1e-9).alias("e")))


sql, ctes = folds.fold_sql("(SELECT modality || '-' || sensor_id AS run, stamp_us AS t, value AS ms, event_id FROM v_sensor)", "run", "t, event_id", {"e": "CAST(NULL AS DOUBLE)"}, {"e": "CASE WHEN f.e IS NULL THEN b.ms ELSE 0.9 * f.e + 0.1 * b.ms END"}, ["event_id"], "SELECT event_id, round(e + 1e-9, 6) + 0.0 AS e FROM o")
section.sql["stage_timing_ewma"] = with_views(sql, *ctes, recursive=True)


@section.add("fault_counts", with_views("SELECT event_id, count(*) OVER (PARTITION BY sensor_id, modality ORDER BY stamp_us, event_id) AS n FROM v_sensor"))
def _(spark, d):
    order = Window.partitionBy("sensor_id", "modality").orderBy("stamp_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return A.sensor(spark, d).select("event_id", F.count(F.lit(1)).over(order).alias("n"))


@section.add("health_rollup", with_views("SELECT sensor_id, min(k % 9) AS dominant, max((k % 9) % 3) AS level, bit_or(1 << (k % 9)) AS codes FROM v_sensor GROUP BY 1"))
def _(spark, d):
    from posegrid.functions.geometry import health_bit

    code = F.col("k") % 9
    return A.sensor(spark, d).groupBy("sensor_id").agg(F.min(code).alias("dominant"), F.max(code % 3).alias("level"), F.bit_or(health_bit(code)).alias("codes"))


def errors(spark, d):
    return A.track(spark, d).withColumn("ex", (F.col("kf_id") % 7 - 3) / 10).withColumn("ey", (F.col("kf_id") % 5 - 2) / 8)


ERR = "e AS (SELECT *, sqrt(ex*ex+ey*ey) AS e FROM (SELECT *, (kf_id % 7 - 3) / 10 AS ex, (kf_id % 5 - 2) / 8 AS ey FROM v_track))"


@section.add("ate_stats", with_views("SELECT run, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, round(max(e), 6) AS max, round(quantile_cont(abs(ex), 0.95), 6) AS p95_x, round(quantile_cont(abs(ey), 0.95), 6) AS p95_y FROM e GROUP BY 1", ERR))
def _(spark, d):
    return rounded(G.ate_stats(errors(spark, d), ["run"]))


FIT = """a AS (SELECT run, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(gx) AS mgx, avg(gy) AS mgy, atan2(avg(x*gy-y*gx)-(avg(x)*avg(gy)-avg(y)*avg(gx)), avg(x*gx+y*gy)-(avg(x)*avg(gx)+avg(y)*avg(gy))) AS yaw FROM g GROUP BY 1)"""
GT = "g AS (SELECT *, y + ex AS gx, -x + ey AS gy FROM e)"


#: The best turn in space of points on a plane: about its normal, or half a turn about a line in it (yaw is then twice that line's angle) where the sums would rather have a mirror.
SPATIAL = """h AS (SELECT run, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(gx) AS mgx, avg(gy) AS mgy, avg(gx*x)-avg(gx)*avg(x) AS xx, avg(gx*y)-avg(gx)*avg(y) AS xy, avg(gy*x)-avg(gy)*avg(x) AS yx, avg(gy*y)-avg(gy)*avg(y) AS yy FROM g GROUP BY 1),
    a AS (SELECT *, CASE WHEN xx*yy < xy*yx THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS up, CASE WHEN xx*yy < xy*yx THEN atan2(yx+xy, xx-yy) ELSE atan2(yx-xy, xx+yy) END AS yaw FROM h)"""
ALIGNED = ", ".join(f"round({v}, 5) + 0.0 AS {n}" for n, v in {"r0": "cos(yaw)", "r1": "-up*sin(yaw)", "r2": "0.0", "r3": "sin(yaw)", "r4": "up*cos(yaw)", "r5": "0.0", "r6": "0.0", "r7": "0.0", "r8": "up", "t0": "mgx - cos(yaw)*mx + up*sin(yaw)*my", "t1": "mgy - sin(yaw)*mx - up*cos(yaw)*my", "t2": "1.0"}.items())


@section.add("umeyama_align", with_views(f"SELECT run, n, {ALIGNED} FROM a WHERE n >= 3", ERR, GT, SPATIAL))
def _(spark, d):
    p = errors(spark, d).select("run", "x", "y", F.lit(0.0).alias("z"), (F.col("y") + F.col("ex")).alias("gx"), (-F.col("x") + F.col("ey")).alias("gy"), F.lit(1.0).alias("gz"))
    return rounded(G.umeyama_align(p, ["run"]).filter("n >= 3").select("run", "n", *[F.col("r")[i].alias(f"r{i}") for i in range(9)], *[F.col("t")[i].alias(f"t{i}") for i in range(3)]), 5)


@section.add("datum_fit", with_views("SELECT run, n, round(yaw, 6) AS yaw, round(mgx - cos(yaw)*mx + sin(yaw)*my, 5) AS tx, round(mgy - sin(yaw)*mx - cos(yaw)*my, 5) AS ty FROM a WHERE n >= 5", ERR, GT, FIT))
def _(spark, d):
    p = errors(spark, d).withColumn("gx", F.col("y") + F.col("ex")).withColumn("gy", -F.col("x") + F.col("ey"))
    out = G.planar_alignment(p, ["run"]).filter("n >= 5")
    return rounded(out.withColumn("tx", F.round("tx", 5)).withColumn("ty", F.round("ty", 5)))


@section.add("gnss_residual_stats", with_views("SELECT run, round(sqrt(avg(e*e)), 6) AS rmse, round(sqrt(avg(e*e) FILTER (t <= t0 + 86400000000 * 90)), 6) AS rmse_fit, round(quantile_cont(e, 0.5), 6) AS median, round(max(e), 6) AS max, arg_min(kf_id, (t, kf_id)) FILTER (e > 0.35) AS onset FROM (SELECT *, min(t) OVER (PARTITION BY run) AS t0 FROM e) GROUP BY 1", ERR))
def _(spark, d):
    e = errors(spark, d).withColumn("e", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")))
    e = e.join(e.groupBy("run").agg(F.min("t").alias("t0")), "run")
    sq, bad = F.col("e") * F.col("e"), F.col("e") > 0.35
    out = e.groupBy("run").agg(
        F.sqrt(F.avg(sq)).alias("rmse"), F.sqrt(F.avg(F.when(F.col("t") <= F.col("t0") + 86_400_000_000 * 90, sq))).alias("rmse_fit"), F.max("e").alias("max"), F.min_by(F.when(bad, F.col("kf_id")), F.when(bad, F.struct("t", "kf_id"))).alias("onset")
    )
    return rounded(out.join(G.medians(e, ["run"], "e"), "run", "left"))


@section.add("phantom_motion", with_views("SELECT run, round(sum(CASE WHEN gt_speed < 100 AND est_speed > 30 THEN est_speed * dt END), 6) AS phantom FROM (SELECT run, (t - lag(t) OVER w) / 8.64e10 AS dt, abs(x - lag(x) OVER w) AS est_speed, abs(y - lag(y) OVER w) AS gt_speed FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id)) GROUP BY 1"))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    s = A.track(spark, d).select("run", ((F.col("t") - F.lag("t").over(w)) / 8.64e10).alias("dt"), F.abs(F.col("x") - F.lag("x").over(w)).alias("est"), F.abs(F.col("y") - F.lag("y").over(w)).alias("gt"))
    return rounded(s.groupBy("run").agg(F.sum(F.when((F.col("gt") < 100) & (F.col("est") > 30), F.col("est") * F.col("dt"))).alias("phantom")))


@section.add("path_length_displacement", with_views("SELECT run, round(coalesce(sum(step), 0), 6) AS length, round(sqrt(pow(arg_max(x, (t, kf_id)) - arg_min(x, (t, kf_id)), 2) + pow(arg_max(y, (t, kf_id)) - arg_min(y, (t, kf_id)), 2)), 6) AS displacement FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id)) GROUP BY 1"))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    s = A.track(spark, d).withColumn("step", F.sqrt(dx * dx + dy * dy)).withColumn("o", F.struct("t", "kf_id"))
    ends = {c: F.max_by(c, "o") - F.min_by(c, "o") for c in "xy"}
    return rounded(s.groupBy("run").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.sqrt(ends["x"] * ends["x"] + ends["y"] * ends["y"]).alias("displacement")))


@section.add("gt_validation", with_views("SELECT run, round(avg(CASE WHEN kf_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS identity_share, coalesce(min(t - p), 1) > 0 AS monotonic, max(t) - min(t) AS span FROM (SELECT *, lag(t) OVER (PARTITION BY run ORDER BY kf_id) AS p FROM v_track) GROUP BY 1"))
def _(spark, d):
    s = A.track(spark, d).withColumn("p", F.lag("t").over(Window.partitionBy("run").orderBy("kf_id")))
    return rounded(s.groupBy("run").agg(F.avg(F.when(F.col("kf_id") % 7 == 0, 1.0).otherwise(0.0)).alias("identity_share"), (F.coalesce(F.min(F.col("t") - F.col("p")), F.lit(1)) > 0).alias("monotonic"), (F.max("t") - F.min("t")).alias("span")))


@section.add("obs_summary", with_views("SELECT sensor_id, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS least, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS low_share FROM v_sensor GROUP BY 1"))
def _(spark, d):
    return rounded(A.sensor(spark, d).groupBy("sensor_id").agg(F.min("value").alias("least"), F.avg(F.when(F.col("value") < 10, 1.0).otherwise(0.0)).alias("low_share")).join(G.medians(A.sensor(spark, d), ["sensor_id"], "value"), "sensor_id"))


@section.add("event_pattern_counts", r"SELECT user_id, count(*) FILTER (regexp_matches(event_type, '^(err|cli)')) AS n_start, count(*) FILTER (regexp_matches(props, '\b7\d?\b')) AS n_seven FROM events GROUP BY 1")
def _(spark, d):
    e = A.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count(F.when(F.col("event_type").rlike("^(err|cli)"), 1)).alias("n_start"), F.count(F.when(F.col("props").rlike(r"\b7\d?\b"), 1)).alias("n_seven"))


@section.add("run_comparison", with_views("SELECT run % 10 AS grp, round(sqrt(avg(e*e)), 6) AS rmse, min(t) FILTER (e > 0.35) AS onset, round(sum(CASE WHEN e < 0.1 THEN x END), 4) AS phantom FROM e GROUP BY 1", ERR))
def _(spark, d):
    e = errors(spark, d).withColumn("e", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")))
    return rounded(e.groupBy((F.col("run") % 10).alias("grp")).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.min(F.when(F.col("e") > 0.35, F.col("t"))).alias("onset"), F.round(F.sum(F.when(F.col("e") < 0.1, F.col("x"))), 4).alias("phantom")))


#: Scale-free information of each pair's matched points (translation first), turned until it is diagonal: eight sweeps of fifteen rotations.
_P, _Q = ([i for i in range(6) for _ in range(i + 1, 6)], [j for i in range(6) for j in range(i + 1, 6)])
_INFO = "[1, 0, 0, 0, z, -y, 0, 1, 0, -z, 0, x, 0, 0, 1, y, -x, 0, 0, -z, y, yy + zz, -xy, -xz, z, 0, -x, -xy, xx + zz, -yz, -y, x, 0, -xz, -yz, xx + yy]"
FITNESS = (
    f"f AS (SELECT g.scan_id % 32 AS pair, round(count(n.id) / count(*), 6) AS overlap, round(sqrt(avg(n.d2)), 6) AS rmse, {', '.join(f'avg({v}) FILTER (n.id IS NOT NULL) AS {k}' for k, v in [(c, f'g.{c}') for c in 'xyz'] + [(c, f'g.{c[0]} * g.{c[1]}') for c in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz')])} FROM g LEFT JOIN (SELECT * FROM {NEAREST.format(1.0)} WHERE n = 1) n ON n.q = g.id GROUP BY 1)",
    f"""h AS (SELECT pair, 0 AS step, CAST({_INFO} AS DOUBLE[]) AS m FROM f WHERE x IS NOT NULL
        UNION ALL SELECT pair, step + 1, list_transform(range(0, 36), lambda k: CASE k // 6 WHEN p THEN c * b[p * 6 + k % 6 + 1] - s * b[q * 6 + k % 6 + 1] WHEN q THEN s * b[p * 6 + k % 6 + 1] + c * b[q * 6 + k % 6 + 1] ELSE b[k + 1] END)
        FROM (SELECT *, list_transform(range(0, 36), lambda k: CASE k % 6 WHEN p THEN c * m[k - k % 6 + p + 1] - s * m[k - k % 6 + q + 1] WHEN q THEN s * m[k - k % 6 + p + 1] + c * m[k - k % 6 + q + 1] ELSE m[k + 1] END) AS b
        FROM (SELECT *, t / sqrt(t * t + 1) AS s, 1 / sqrt(t * t + 1) AS c FROM (SELECT *, CASE WHEN m[p * 6 + q + 1] = 0 THEN 0 ELSE CASE WHEN theta < 0 THEN -1 ELSE 1 END / (abs(theta) + sqrt(theta * theta + 1)) END AS t
        FROM (SELECT *, (m[q * 7 + 1] - m[p * 7 + 1]) / (2 * CASE WHEN m[p * 6 + q + 1] = 0 THEN 1 ELSE m[p * 6 + q + 1] END) AS theta FROM (SELECT *, {_P}[step % 15 + 1] AS p, {_Q}[step % 15 + 1] AS q FROM h WHERE step < 120))))))""",
    "e AS (SELECT pair, least(m[1], m[8], m[15], m[22], m[29], m[36]) AS lo, greatest(m[1], m[8], m[15], m[22], m[29], m[36]) AS hi FROM h WHERE step = 120)",
)


@section.add("gicp_fitness", with_views("SELECT *, overlap >= 0.9 AND rmse <= 0.5 AND coalesce(cond <= 1e4, false) AS accepted FROM (SELECT pair, overlap, rmse, CASE WHEN lo > 1e-9 * hi THEN round(hi / lo, 2) END AS cond FROM f LEFT JOIN e USING (pair))", GRID.format(1.0), PAIRS, *FITNESS, recursive=True))
def _(spark, d):
    """Share of points with a partner, their distance, the condition number of what the partners say about the pose, and whether a pair passes all gates.

    The information counts each partner alike in all directions; a ratio of eigenvalues beyond 1e9 counts as none. Pairs aren't moved
    here: ``loop_verify`` registers them, and weighs partners by their surfaces.
    """
    from posegrid.operators.joins import voxel_nn

    matched = voxel_nn(_queries_targets(spark, d)[0], None, 1.0, 1.0, apart="scan_id", whole=True)
    mean = {c: F.col(c) for c in "xyz"} | {a + b: F.col(a) * F.col(b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    means = matched.groupBy((F.col("scan_id") % 32).alias("pair")).agg(
        (F.count("id") / F.count(F.lit(1))).alias("overlap"), F.sqrt(F.avg("d2")).alias("rmse"), *[F.avg(F.when(F.col("id").isNotNull(), v)).alias(f"m_{k}") for k, v in mean.items()]
    )

    @F.pandas_udf("double")
    def condition(x: pd.Series, y: pd.Series, z: pd.Series, xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
        h = np.zeros((len(x), 6, 6))
        h[:, [0, 1, 2], [0, 1, 2]] = 1.0
        for i, j, v in ((0, 4, z), (0, 5, -y), (1, 3, -z), (1, 5, x), (2, 3, y), (2, 4, -x), (3, 3, yy + zz), (4, 4, xx + zz), (5, 5, xx + yy), (3, 4, -xy), (3, 5, -xz), (4, 5, -yz)):
            h[:, i, j] = h[:, j, i] = v
        known = np.isfinite(h).all(axis=(1, 2))
        value = np.linalg.eigvalsh(np.where(known[:, None, None], h, 0.0))
        sound = known & (value[:, 0] > 1e-9 * value[:, -1])
        return pd.Series(np.where(sound, value[:, -1] / np.where(sound, value[:, 0], 1.0), np.nan)).astype("Float64").mask(~sound)

    out = rounded(means.select("pair", "overlap", "rmse", F.round(condition(*[f"m_{k}" for k in mean]), 2).alias("cond")))
    return out.withColumn("accepted", (F.col("overlap") >= 0.9) & (F.col("rmse") <= 0.5) & F.coalesce(F.col("cond") <= 1e4, F.lit(False)))


@section.add("height_normalise", with_views("SELECT scan_id, idx, round(CASE WHEN hi > lo THEN (z - lo) / (hi - lo) ELSE 0.5 END, 6) + 0.0 AS h FROM (SELECT *, min(z) OVER (PARTITION BY scan_id) AS lo, max(z) OVER (PARTITION BY scan_id) AS hi FROM v_point)"))
def _(spark, d):
    w = Window.partitionBy("scan_id")
    lo, hi = F.min("z").over(w), F.max("z").over(w)
    return rounded(A.point(spark, d).select("scan_id", "idx", F.when(hi > lo, (F.col("z") - lo) / (hi - lo)).otherwise(0.5).alias("h")))


@section.add("range_image", with_views("SELECT scan_id, \"row\", col, round(min(r), 6) AS range FROM (SELECT scan_id, r, CAST(floor((degrees(asin(z / r)) + 5) / 50 * 16) AS BIGINT) AS \"row\", CAST(floor((CASE WHEN degrees(atan2(y,x)) < 0 THEN degrees(atan2(y,x)) + 360 ELSE degrees(atan2(y,x)) END) / 360 * 90) AS BIGINT) % 90 AS col FROM (SELECT *, sqrt(x*x+y*y+z*z) AS r FROM v_point)) WHERE \"row\" BETWEEN 0 AND 15 GROUP BY 1, 2, 3"))
def _(spark, d):
    return rounded(G.range_image(A.point(spark, d), 16, 90, -5.0, 45.0, ["scan_id"]))


_CROSS = {"u": ("a - low", "e", "f", "e", "b - low", "g"), "v": ("a - low", "e", "f", "f", "g", "c - low"), "w": ("e", "b - low", "g", "f", "g", "c - low")}
_VECTORS = ", ".join(f"({p[1]})*({p[5]}) - ({p[2]})*({p[4]}) AS {k}x, ({p[2]})*({p[3]}) - ({p[0]})*({p[5]}) AS {k}y, ({p[0]})*({p[4]}) - ({p[1]})*({p[3]}) AS {k}z" for k, p in _CROSS.items())
_BEST = ", ".join(f"CASE WHEN su >= sv AND su >= sw THEN u{t} / sqrt(su) WHEN sv >= sw THEN v{t} / sqrt(sv) ELSE w{t} / sqrt(sw) END AS n{t}" for t in "xyz")
#: Scatter of each point's neighbours within its group (two hundred scans), its least eigenvector, and the rows of the normal matrix.
NORMALS = (
    "o AS (SELECT scan_id // 200 AS run, (scan_id << 20) + idx AS q, x / 5 AS x, y / 5 AS y, z / 5 AS z, floor(x / 5) AS cx, floor(y / 5) AS cy, floor(z / 5) AS cz FROM v_point)",
    "d AS (SELECT p.run, p.q, b.x - p.x AS x, b.y - p.y AS y, b.z - p.z AS z FROM (SELECT *, cx + i AS px, cy + j AS py, cz + k AS pz FROM o, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) p JOIN o b ON b.run = p.run AND b.cx = p.px AND b.cy = p.py AND b.cz = p.pz WHERE pow(b.x - p.x, 2) + pow(b.y - p.y, 2) + pow(b.z - p.z, 2) <= 1)",
    "m AS (SELECT run, q, sum(x*x) - sum(x)*sum(x)/count(*) AS a, sum(y*y) - sum(y)*sum(y)/count(*) AS b, sum(z*z) - sum(z)*sum(z)/count(*) AS c, sum(x*y) - sum(x)*sum(y)/count(*) AS e, sum(x*z) - sum(x)*sum(z)/count(*) AS f, sum(y*z) - sum(y)*sum(z)/count(*) AS g FROM d GROUP BY 1, 2 HAVING count(*) >= 5)",
    "m2 AS (SELECT *, sqrt((pow(a - mean, 2) + pow(b - mean, 2) + pow(c - mean, 2) + 2 * (e*e + f*f + g*g)) / 6) AS size FROM (SELECT *, (a + b + c) / 3 AS mean FROM m))",
    "m3 AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a-mean)*((b-mean)*(c-mean) - g*g) - e*(e*(c-mean) - g*f) + f*(e*g - (b-mean)*f)) / pow(size, 3) / 2))) / 3 AS angle FROM m2 WHERE size > 0)",
    "m4 AS (SELECT *, mean + 2 * size * cos(angle + 2 * pi() / 3) AS low, mean + 2 * size * cos(angle) AS high FROM m3)",
    f"m5 AS (SELECT *, {', '.join(f'{k}x*{k}x + {k}y*{k}y + {k}z*{k}z AS s{k}' for k in 'uvw')} FROM (SELECT run, q, size, {_VECTORS} FROM m4 WHERE 3 * mean - low - high > greatest(1e-12, 1e-6 * high)))",
    f"m6 AS (SELECT run, q, {_BEST} FROM m5 WHERE greatest(su, sv, sw) > pow(size, 4) * 1e-16)",
    "m7 AS (SELECT o.run, count(nx) AS n, avg(nx*nx) AS h0, avg(ny*ny) AS h1, avg(nz*nz) AS h2, avg(pow(y*nz - z*ny, 2)) AS h3, avg(pow(z*nx - x*nz, 2)) AS h4, avg(pow(x*ny - y*nx, 2)) AS h5 FROM o LEFT JOIN m6 USING (run, q) GROUP BY 1)",
)


@section.add("observability_score", with_views("SELECT run, n, " + ", ".join(f"round(coalesce(h{i} / (h{i} + 0.01), 0), 4) + 0.0 AS s{i}" for i in range(6)) + " FROM m7", *NORMALS))
def _(spark, d):
    """Scores of each group of scans from the normals of its surfaces."""
    from .joins import point_id

    p = A.point(spark, d).select(F.floor(F.col("scan_id") / 200).alias("run"), point_id().alias("q"), *[(F.col(a) / 5).alias(a) for a in "xyz"])
    return rounded(G.observability_scores(p, ("run",), 1.0), 4)
