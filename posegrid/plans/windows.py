"""Queries of windows, folds, ordering and set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from posegrid import adapters as A
from posegrid.adapters import with_views
from posegrid.functions import manifold
from posegrid.operators import place
from posegrid.operators import windows as O
from posegrid.operators.folds import fold_sql, streamed_fold
from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Section, rounded

section = Section()
col = F.col
S = "s AS (SELECT modality || '-' || sensor_id AS run, stamp_us AS t, value AS v, k, event_id FROM v_sensor)"
RUN = "(SELECT modality || '-' || sensor_id AS run, stamp_us AS t, value AS v, k, event_id FROM v_sensor)"
HOUR = 3_600_000_000


def streams(spark, d):
    return A.sensor(spark, d).select(F.concat_ws("-", "modality", "sensor_id").alias("run"), col("stamp_us").alias("t"), col("value").alias("v"), "k", "event_id")


def folded(name: str, view: str, key: str, order: str, init: dict, step: dict, keep: list[str], select: str):
    sql, ctes = fold_sql(view, key, order, init, step, keep, select)
    return section.add(name, with_views(sql, *ctes, recursive=True))


@section.add("monotonic_clamp", with_views("SELECT event_id, greatest(u, coalesce(top, u)) AS clamped, coalesce(u < top, false) AS clock_step FROM (SELECT *, max(u) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT *, t + (k % 5) * 36000000000 AS u FROM s))", S))
def _(spark, d):
    s = streams(spark, d).withColumn("u", col("t") + (col("k") % 5) * 36_000_000_000)
    return O.monotonic_clamp(s, ["run"], ["event_id"], "u").select("event_id", "clamped", "clock_step")


@section.add("gap_detect", with_views(f"SELECT event_id, CASE WHEN gap > {HOUR * 40} THEN 'failed' WHEN gap > {2.5 * HOUR * 4} THEN 'dropout' ELSE 'ok' END AS state FROM (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY t, event_id) AS gap FROM s)", S))
def _(spark, d):
    return O.gap_detect(streams(spark, d), ["run"], "t", HOUR * 4, HOUR * 40).select("event_id", "state")


INST = "(SELECT *, CASE WHEN t > lag(t) OVER w THEN 1e6 / (t - lag(t) OVER w) END * 1e6 AS inst FROM " + RUN + " WINDOW w AS (PARTITION BY run ORDER BY t, event_id))"
EWMA = dict(init={"rate": "CAST(NULL AS DOUBLE)"}, step={"rate": "CASE WHEN b.inst IS NULL THEN f.rate WHEN f.rate IS NULL THEN b.inst ELSE f.rate + 0.1 * (b.inst - f.rate) END"})


@folded("rate_ewma", INST, "run", "t, event_id", EWMA["init"], EWMA["step"], ["event_id"], "SELECT event_id, round(rate, 6) + 0.0 AS rate FROM o")
def _(spark, d):
    return rounded(O.rate_ewma(streams(spark, d), ["run"], "t", second=1e12).select("event_id", "rate"))


@folded("rate_band", INST, "run", "t, event_id", EWMA["init"], EWMA["step"], ["event_id"], "SELECT event_id, CASE WHEN rate < 64 THEN 'low' WHEN rate > 96 THEN 'high' ELSE 'ok' END AS band FROM o")
def _(spark, d):
    return O.rate_band(O.rate_ewma(streams(spark, d), ["run"], "t", second=1e12), 80.0).select("event_id", "band")


@section.add("sync_lost", with_views("SELECT event_id, k % 4 = 0 AND k % 3 <> 0 AS sync_lost FROM s", S))
def _(spark, d):
    hw, soft = col("k") % 4 == 0, col("k") % 3 != 0
    return streams(spark, d).select("event_id", (hw & soft).alias("sync_lost"))


@section.add("skew_band", with_views("SELECT event_id, abs((k - 50) * 5.0) > 200 AS out_of_band FROM s", S))
def _(spark, d):
    return streams(spark, d).select("event_id", (F.abs((col("k") - 50) * 5.0) > 200).alias("out_of_band"))


@section.add("level_transition", with_views("SELECT event_id, level FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY run ORDER BY t, event_id), 0) AS p FROM (SELECT *, k % 3 AS level FROM s)) WHERE level <> p", S))
def _(spark, d):
    return O.level_transition(streams(spark, d).withColumn("level", col("k") % 3), ["run"], ["t", "event_id"], "level").select("event_id", "level")


EDGE = """e AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY run, island ORDER BY t, event_id) ELSE 0 END AS streak FROM (SELECT *, sum(CASE WHEN NOT bad OR emit THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, event_id) AS island
    FROM (SELECT *, bad AND NOT coalesce(lag(bad) OVER (PARTITION BY run ORDER BY t, event_id), false) AS emit FROM (SELECT *, k % 3 > 0 AS bad FROM s))))"""


@section.add("edge_throttle", with_views("SELECT event_id, emit, streak FROM e", S, EDGE))
def _(spark, d):
    return O.edge_throttle(streams(spark, d), ["run"], ["t", "event_id"], col("k") % 3 > 0).select("event_id", "emit", "streak")


LIMIT = dict(init={"last": "CAST(NULL AS BIGINT)", "out_": "false"}, step={"last": "CASE WHEN f.last IS NULL OR b.t - f.last >= {0} THEN b.t ELSE f.last END", "out_": "f.last IS NULL OR b.t - f.last >= {0}"})
for name, view, interval in (("rate_limit", RUN, 12 * HOUR), ("path_sample", RUN, 30 * HOUR), ("repeat_suppress", RUN.replace("modality || '-' || sensor_id", "modality || '-' || (k % 5)"), 24 * HOUR)):

    def _(spark, d, name=name, interval=interval):
        s = streams(spark, d)
        if name == "repeat_suppress":  # a stream for each code
            s = A.sensor(spark, d).select(F.concat_ws("-", "modality", (col("k") % 5).cast("string")).alias("run"), col("stamp_us").alias("t"), "event_id")
        return O.rate_limit(s, ["run"], "t", interval).select("event_id")

    folded(name, view, "run", "t, event_id", LIMIT["init"], {k: v.format(interval) for k, v in LIMIT["step"].items()}, ["event_id"], "SELECT event_id FROM o WHERE out_")(_)

STEPS = "(SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id))"


@folded("spacing_decimate", STEPS, "run", "t, kf_id", {"way": "0.0::DOUBLE"}, {"way": "CASE WHEN f.way >= 700 THEN 0.0 ELSE f.way END + b.step"}, ["kf_id"], "SELECT run, kf_id FROM o WHERE way >= 700")
def _(spark, d):
    return O.spacing_decimate(A.track(spark, d), ["run"], ["t", "kf_id"], 700.0)


FAR = "f.kx IS NULL OR pow(b.x - f.kx, 2) + pow(b.y - f.ky, 2) >= 90000 OR b.t - f.kt >= 17280000000000"


@folded("keyframe_select", "v_track", "run", "t, kf_id", {"kx": "CAST(NULL AS DOUBLE)", "ky": "CAST(NULL AS DOUBLE)", "kt": "CAST(NULL AS BIGINT)", "take": "false"}, {c: f"CASE WHEN {FAR} THEN b.{v} ELSE f.{c} END" for c, v in (("kx", "x"), ("ky", "y"), ("kt", "t"))} | {"take": FAR}, ["kf_id"], "SELECT run, kf_id FROM o WHERE take")
def _(spark, d):
    return O.keyframe_select(A.track(spark, d), ["run"], ["t", "kf_id"], 300.0, 17_280_000_000_000)


MOVED = "f.kx IS NULL OR sqrt(pow(b.x - f.kx, 2) + pow(b.y - f.ky, 2)) > 250"


@folded("moved_set", "v_track", "run", "t, kf_id", {"kx": "CAST(NULL AS DOUBLE)", "ky": "CAST(NULL AS DOUBLE)", "take": "false"}, {c: f"CASE WHEN {MOVED} THEN b.{v} ELSE f.{c} END" for c, v in (("kx", "x"), ("ky", "y"))} | {"take": MOVED}, ["kf_id"], "SELECT run, kf_id FROM o WHERE take")
def _(spark, d):
    return O.moved_set(A.track(spark, d), ["run"], ["t", "kf_id"], 250.0)


@folded("cooldown_select", "v_track", "run", "t, kf_id", {"last": "CAST(NULL AS BIGINT)", "take": "false"}, {"last": "CASE WHEN f.last IS NULL OR b.t - f.last >= 20000000000000 THEN b.t ELSE f.last END", "take": "f.last IS NULL OR b.t - f.last >= 20000000000000"}, ["kf_id"], "SELECT run, kf_id FROM o WHERE take")
def _(spark, d):
    return O.cooldown_select(A.track(spark, d), ["run"], ["t", "kf_id"], "t", 20_000_000_000_000)


@section.add("dedup_watermark", with_views("SELECT event_id FROM (SELECT *, max(u) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT *, t + (k % 5) * 36000000000 AS u FROM s)) WHERE top IS NULL OR u > top", S))
def _(spark, d):
    return O.dedup_watermark(streams(spark, d).withColumn("u", col("t") + (col("k") % 5) * 36_000_000_000), ["run"], ["event_id"], "u").select("event_id")


@section.add("dedup_close_stamps", with_views(f"SELECT event_id FROM (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY t, event_id) AS gap FROM s) WHERE gap IS NULL OR gap > {HOUR}", S))
def _(spark, d):
    return O.dedup_close_stamps(streams(spark, d), ["run"], "t", HOUR).select("event_id")


@section.add("chi2_run_disable", with_views("SELECT event_id, max(CASE WHEN streak >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, event_id) = 1 AS disabled FROM e", S, EDGE))
def _(spark, d):
    return O.run_disable(streams(spark, d), ["run"], ["t", "event_id"], col("k") % 3 > 0, 4).select("event_id", "disabled")


@section.add("latch_first", with_views("SELECT run, arg_min(event_id, (t, event_id)) AS origin FROM s WHERE k >= 50 GROUP BY 1", S))
def _(spark, d):
    return streams(spark, d).filter("k >= 50").groupBy("run").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("origin"))


DT = "(SELECT *, coalesce((t - lag(t) OVER (PARTITION BY run ORDER BY t, event_id)) / 3.6e9, 0) AS dt FROM " + RUN + ")"
GAIN = "((f.p + 0.5*b.dt*0.5*b.dt/3) / ((f.p + 0.5*b.dt*0.5*b.dt/3) + 2.0))"


@folded("accel_magnitude_kf", DT, "run", "t, event_id", {"e": "CAST(NULL AS DOUBLE)", "p": "0.0::DOUBLE"}, {"e": f"CASE WHEN f.e IS NULL THEN b.v ELSE f.e + {GAIN} * (b.v - f.e) END", "p": f"CASE WHEN f.e IS NULL THEN 2.0 ELSE (1 - {GAIN}) * (f.p + 0.5*b.dt*0.5*b.dt/3) END"}, ["event_id"], "SELECT event_id, round(e, 5) + 0.0 AS e, round(p, 5) + 0.0 AS p FROM o")
def _(spark, d):
    return rounded(O.accel_magnitude_kf(streams(spark, d), ["run"], ["t", "event_id"], "v", 0.5, 2.0).drop("run"), 5)


U = "(SELECT run, t, event_id, (row_number() OVER (PARTITION BY run ORDER BY t, event_id) - 1) / 10 AS u, k / 100 + (row_number() OVER (PARTITION BY run ORDER BY t, event_id) - 1) / 50 AS y FROM " + RUN + ")"
DEN = "(0.995 + (f.p00 + f.p01*b.u) + (f.p01 + f.p11*b.u)*b.u)"
G0, G1, ERR_ = "(f.p00 + f.p01*b.u)", "(f.p01 + f.p11*b.u)", "(b.y - f.b0 - f.b1*b.u)"


@folded("clock_rls", U, "run", "t, event_id", {"b0": "0.0::DOUBLE", "b1": "0.0::DOUBLE", "p00": "1e6::DOUBLE", "p01": "0.0::DOUBLE", "p11": "1e4::DOUBLE"},
    {"b0": f"f.b0 + {G0}/{DEN}*{ERR_}", "b1": f"f.b1 + {G1}/{DEN}*{ERR_}", "p00": f"(f.p00 - {G0}/{DEN}*{G0})/0.995", "p01": f"(f.p01 - {G0}/{DEN}*{G1})/0.995", "p11": f"(f.p11 - {G1}/{DEN}*{G1})/0.995"}, ["event_id"], "SELECT event_id, round(b0, 4) + 0.0 AS b0, round(b1, 4) + 0.0 AS b1 FROM o")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("run").orderBy("t", "event_id")) - 1
    p = streams(spark, d).select("run", "t", "event_id", (n / 10).alias("u"), (col("k") / 100 + n / 50).alias("y"))
    return rounded(O.clock_rls(p, ["run"], ["t", "event_id"]).select("event_id", "b0", "b1"), 4)


@section.add("clock_to_timeline", with_views("SELECT event_id, CASE WHEN k % 2 = 0 THEN t ELSE t0 + CAST(round(((t - t0) - 5000) / (1 + 1.2e-4)) AS BIGINT) END AS stamp FROM (SELECT *, min(t) OVER (PARTITION BY run) AS t0 FROM s)", S))
def _(spark, d):
    s = streams(spark, d)
    s = s.join(s.groupBy("run").agg(F.min("t").alias("t0")), "run")
    return s.select("event_id", F.when(col("k") % 2 == 0, col("t")).otherwise(col("t0") + F.round(((col("t") - col("t0")) - 5000) / (1 + 1.2e-4)).cast("long")).alias("stamp"))


@section.add("ptp_pps_state", with_views("SELECT event_id, coalesce(last_value(lock IGNORE NULLS) OVER (PARTITION BY run ORDER BY t, event_id), false) AND k <= 50 AS disciplined FROM (SELECT *, CASE WHEN k % 5 = 0 THEN k % 2 = 0 END AS lock FROM s)", S))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    lock = F.when(col("k") % 5 == 0, col("k") % 2 == 0)
    return streams(spark, d).withColumn("lock", lock).select("event_id", (F.coalesce(F.last("lock", True).over(w), F.lit(False)) & (col("k") <= 50)).alias("disciplined"))


SLOPE = "CASE WHEN lag(x) OVER w IS NULL AND lead(x) OVER w IS NULL THEN 0.0 WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END"


@section.add("speed_profile", with_views(f"SELECT kf_id, round(sum(g) OVER (PARTITION BY run ORDER BY t, kf_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 + 1e-9, 5) + 0.0 AS speed FROM (SELECT *, {SLOPE} AS g FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id))"))
def _(spark, d):
    return rounded(O.profile(A.track(spark, d), ["run"], ["t", "kf_id"], col("x"), "speed", 1).select("kf_id", (col("speed") + 1e-9).alias("speed")), 5)


@section.add("heading_profile", with_views(f"SELECT kf_id, round({SLOPE.replace('(x)', '(h)').replace('- x ', '- h ').replace('THEN x -', 'THEN h -')}, 6) + 0.0 AS heading FROM (SELECT *, atan2(y, x) AS h FROM v_track) WINDOW w AS (PARTITION BY run ORDER BY t, kf_id)"))
def _(spark, d):
    return rounded(O.profile(A.track(spark, d), ["run"], ["t", "kf_id"], F.atan2("y", "x"), "heading").select("kf_id", "heading"))


MONTH = 30 * 86_400_000_000
SEGMENTS = (
    "m0 AS (SELECT *, x > 150 AS moving FROM v_track)",
    "m1 AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY t, kf_id) AS s FROM (SELECT *, CASE WHEN coalesce(lag(moving) OVER (PARTITION BY run ORDER BY t, kf_id) <> moving, true) THEN 1 ELSE 0 END AS nw FROM m0))",
    "m2 AS (SELECT run, s, bool_or(moving) AS moving, min(t) AS a, max(t) AS b, count(*) AS n, arg_min(x, (t, kf_id)) AS ax, arg_min(y, (t, kf_id)) AS ay, arg_max(x, (t, kf_id)) AS bx, arg_max(y, (t, kf_id)) AS b_y FROM m1 GROUP BY 1, 2)",
    # the motion of the last stretch that is kept, found by its number
    f"m3 AS (SELECT m.* EXCLUDE moving, k.moving FROM (SELECT *, max(CASE WHEN s = 1 OR b - a >= {MONTH} THEN s END) OVER (PARTITION BY run ORDER BY s) AS k FROM m2) m JOIN m2 k ON k.run = m.run AND k.s = m.k)",
    "m4 AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY s) AS segment FROM (SELECT *, CASE WHEN coalesce(lag(moving) OVER (PARTITION BY run ORDER BY s) <> moving, true) THEN 1 ELSE 0 END AS nw FROM m3))",
    "m5 AS (SELECT run, CAST(segment AS BIGINT) AS segment, bool_or(moving) AS moving, min(a) AS a, max(b) AS b, CAST(sum(n) AS BIGINT) AS n, arg_max(bx, s) - arg_min(ax, s) AS dx, arg_max(b_y, s) - arg_min(ay, s) AS dy FROM m4 GROUP BY 1, 2)",
    "m6 AS (SELECT *, lag(h) OVER w AS p, lead(h) OVER w AS q FROM (SELECT *, CASE WHEN moving AND sqrt(dx*dx + dy*dy) > 0.05 THEN degrees(atan2(dy, dx)) END AS h FROM m5) WINDOW w AS (PARTITION BY run ORDER BY segment))",
    "m7 AS (SELECT *, CASE WHEN moving THEN 'forward' WHEN abs(((q - p + 180) % 360 + 360) % 360 - 180) > 20 THEN 'turn' ELSE 'stationary' END AS kind FROM m6)",
)


@section.add("motion_segments", with_views("SELECT run, segment, kind, a AS start, b AS \"end\", n, round(CASE kind WHEN 'forward' THEN h WHEN 'turn' THEN q - p END, 6) + 0.0 AS heading FROM m7", *SEGMENTS))
def _(spark, d):
    """Stretches of motion of each run; those under a month belong to the one before."""
    return rounded(O.motion_segments(A.track(spark, d), ["run"], ["t", "kf_id"], col("x") > 150, "t", MONTH))


@section.add("onset_sustained", with_views("SELECT run, arg_min(kf_id, (t, kf_id)) AS onset FROM (SELECT *, avg(e) OVER (PARTITION BY run ORDER BY t, kf_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM n JOIN (SELECT run, greatest(100.0, 1.2 * quantile_cont(e, 0.5)) AS lim FROM n WHERE i <= greatest(1, m // 4) GROUP BY 1) USING (run)) WHERE e > lim AND ahead > lim GROUP BY 1",
    "n AS (SELECT *, abs(x - 200) AS e, row_number() OVER (PARTITION BY run ORDER BY t, kf_id) AS i, count(*) OVER (PARTITION BY run) AS m FROM v_track)"))
def _(spark, d):
    return O.onset_sustained(A.track(spark, d).withColumn("e", F.abs(col("x") - 200)), ["run"], ["t", "kf_id"], "e", 100.0, 1.2)


DISP = "n AS (SELECT *, abs(x - first_value(x) OVER (PARTITION BY run ORDER BY t, kf_id)) - abs(y - first_value(y) OVER (PARTITION BY run ORDER BY t, kf_id)) AS e FROM v_track)"


@section.add("onset_displacement", with_views("SELECT run, min(t) AS onset FROM n WHERE e > 50 GROUP BY 1", DISP))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    e = A.track(spark, d).withColumn("e", F.abs(col("x") - F.first("x").over(w)) - F.abs(col("y") - F.first("y").over(w)))
    return e.filter("e > 50").groupBy("run").agg(F.min("t").alias("onset"))


@section.add("coincident_events", with_views(f"SELECT o.event_id AS onset, s.run, count(*) FILTER (s.v > 3 * m) AS spikes, count(*) FILTER (s.v < 0.5 * m) AS drops FROM (SELECT event_id, t FROM s WHERE k = 99 AND run LIKE 'fault%') o JOIN (SELECT *, median(v) OVER (PARTITION BY run) AS m FROM s) s ON s.t BETWEEN o.t - {2 * HOUR} AND o.t + {2 * HOUR} GROUP BY 1, 2", S))
def _(spark, d):
    from posegrid.operators.aggregations import medians
    from posegrid.operators.joins import interval_join

    s = streams(spark, d)
    s = s.join(medians(s, ["run"], "v").withColumnRenamed("median", "m"), "run")
    onsets = s.filter("k = 99 and run like 'fault%'").select(col("event_id").alias("onset"), (col("t") - 2 * HOUR).alias("lo"), (col("t") + 2 * HOUR).alias("hi"))
    near = interval_join(onsets, s, "lo", "hi", "t", 4 * HOUR)
    return near.groupBy("onset", "run").agg(F.count(F.when(col("v") > 3 * col("m"), 1)).alias("spikes"), F.count(F.when(col("v") < 0.5 * col("m"), 1)).alias("drops"))


@section.add("cumulative_distance", with_views("SELECT kf_id, round(sum(step) OVER (PARTITION BY run ORDER BY t, kf_id), 5) AS way FROM " + STEPS))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    dx, dy = col("x") - F.lag("x").over(w), col("y") - F.lag("y").over(w)
    s = A.track(spark, d).withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return rounded(s.select("kf_id", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("way")), 5)


@section.add("sparse_profile", with_views("SELECT run, kf_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t, kf_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS m FROM v_track) WHERE i IN (SELECT unnest([k * (m - 1) // 3 for k in [0, 1, 2, 3]]))"))
def _(spark, d):
    return O.sparse_profile(A.track(spark, d), ["run"], ["t", "kf_id"], 4).select("run", "kf_id")


@section.add("upstream_loss", with_views(f"SELECT event_id, missed, round(sum(missed) OVER w / (sum(missed) OVER w + count(*) OVER w), 6) AS share FROM (SELECT *, coalesce(greatest(0, CAST(round((t - lag(t) OVER (PARTITION BY run ORDER BY t, event_id)) / {12.0 * HOUR}) AS BIGINT) - 1), 0) AS missed FROM s) WINDOW w AS (PARTITION BY run ORDER BY t, event_id)", S))
def _(spark, d):
    return rounded(O.upstream_loss(streams(spark, d), ["run"], "t", 12.0 * HOUR).select("event_id", "missed", "share"))


@section.add("submap_window", with_views("SELECT kf_id, CAST(list(kf_id) OVER (PARTITION BY run ORDER BY t, kf_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS VARCHAR) AS ids FROM v_track"))
def _(spark, d):
    w = place.submap_window(A.track(spark, d), 3, ["run"], ["t", "kf_id"], "kf_id")
    return w.select("kf_id", F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]")).alias("ids"))


@section.add("excitation_accum", with_views("SELECT run, min(t) AS ready FROM (SELECT *, sum(abs(dx)) OVER (PARTITION BY run ORDER BY t, kf_id) AS trans, sum(abs(dy)) OVER (PARTITION BY run ORDER BY t, kf_id) AS rot FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id))) WHERE trans >= 200 AND rot >= 500 GROUP BY 1"))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    s = A.track(spark, d).withColumn("dx", F.abs(col("x") - F.lag("x").over(w))).withColumn("dy", F.abs(col("y") - F.lag("y").over(w)))
    s = s.withColumn("trans", F.sum("dx").over(w)).withColumn("rot", F.sum("dy").over(w))
    return s.filter("trans >= 200 and rot >= 500").groupBy("run").agg(F.min("t").alias("ready"))


@section.add("instant_speed", with_views("SELECT kf_id, round(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / nullif((t - lag(t) OVER w) / 8.64e10, 0), 5) AS speed FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id)"))
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    dx, dy, dt = col("x") - F.lag("x").over(w), col("y") - F.lag("y").over(w), (col("t") - F.lag("t").over(w)) / 8.64e10
    return rounded(A.track(spark, d).select("kf_id", (F.sqrt(dx * dx + dy * dy) / F.nullif(dt, F.lit(0.0))).alias("speed")), 5)


# --- state that is not a scalar: streamed, with constant memory


RELATED = "(SELECT *, CASE WHEN kf_id % 5 = 0 THEN lag(kf_id, 2) OVER w ELSE lag(kf_id) OVER w END AS rel FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id))"
CHAINS = "(f.last IS NULL OR b.rel = f.last)"


@folded("keyframe_contiguity", RELATED, "run", "t, kf_id", {"last": "CAST(NULL AS BIGINT)", "ok": "false"}, {"last": f"CASE WHEN {CHAINS} THEN b.kf_id ELSE f.last END", "ok": f"coalesce({CHAINS}, false)"}, ["kf_id"], "SELECT run, kf_id, last, ok FROM o")
def _(spark, d):
    """Edges that chain to the last accepted id of their run; here each fifth pose names the one before the last."""
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    e = A.track(spark, d).withColumn("rel", F.when(col("kf_id") % 5 == 0, F.lag("kf_id", 2).over(w)).otherwise(F.lag("kf_id").over(w))).select("run", "t", "kf_id", "rel")

    def step(s, r):
        good = s["last"] is None or r["rel"] == s["last"]
        return {"last": r["kf_id"] if good else s["last"], "ok": good}

    return streamed_fold(e, ["run"], ["t", "kf_id"], {"last": None, "ok": False}, step, ["kf_id"], "last bigint, ok boolean")


RING, WINDOW_US, MOST, PERSIST = 8, 12 * HOUR, 5.0, 3
_SEEN = f"list_filter(f.ring, lambda e: b.t - e.t >= {WINDOW_US})[1]"
_OFF = f"abs((b.v - {_SEEN}.v) / ((b.t - {_SEEN}.t) / {HOUR}.0) - b.speed)"
_N = f"CASE WHEN {_OFF} IS NULL THEN f.n WHEN {_OFF} > {MOST} THEN f.n + 1 ELSE 0 END"
_REJECT = f"({_OFF} IS NOT NULL AND {_N} >= {PERSIST})"


@folded(
    "spoof_run", f"(SELECT *, CASE WHEN k % 10 > 0 THEN (k - 50) / 10.0 END AS speed FROM {RUN} WHERE run LIKE 'gnss%')", "run", "t, event_id",
    {"ring": "[]::STRUCT(t BIGINT, v DOUBLE)[]", "n": "0::BIGINT", "reject": "false"}, {"ring": f"CASE WHEN {_REJECT} THEN f.ring ELSE list_append(f.ring, {{'t': b.t, 'v': b.v}})[-{RING}:] END", "n": _N, "reject": _REJECT}, ["event_id"],
    "SELECT run, event_id, n, reject FROM o",
)
def _(spark, d):
    """Fixes whose velocity over half a day and more disagrees with a reference three times in a row."""
    s = streams(spark, d).filter("run like 'gnss%'").withColumn("speed", F.when(col("k") % 10 > 0, (col("k") - 50) / 10))
    return O.spoof_run(s, ["run"], ["t", "event_id"], "t", "v", "speed", ["event_id"], WINDOW_US, HOUR, MOST, PERSIST, RING)


GAP, FAIL = f"coalesce(b.t - f.seen > {24 * HOUR}, false)", "b.k < 10"


@folded("gap_reseed", RUN, "run", "t, event_id", {"seen": "CAST(NULL AS BIGINT)", "armed": "false", "cleared": "false", "bridged": "false"}, {"seen": "b.t", "armed": f"(f.armed OR {GAP}) AND NOT {FAIL}", "cleared": f"(f.armed OR {GAP}) AND {FAIL}", "bridged": GAP}, ["event_id"], "SELECT run, event_id, armed, cleared, bridged FROM o")
def _(spark, d):
    def step(s, r):
        gap = s["t"] is not None and r["t"] - s["t"] > 24 * HOUR
        fail = r["k"] < 10
        return {"t": r["t"], "armed": (s["armed"] or gap) and not fail, "cleared": bool((s["armed"] or gap) and fail), "bridged": gap}

    return streamed_fold(streams(spark, d), ["run"], ["t", "event_id"], {"t": None, "armed": False, "cleared": False, "bridged": False}, step, ["event_id"], "armed boolean, cleared boolean, bridged boolean")


@folded("detect_cooldown", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t, kf_id) AS n FROM v_track) WHERE n % 2 = 0)", "run", "n", {"last": "CAST(NULL AS BIGINT)", "take": "false"}, {"last": "CASE WHEN f.last IS NULL OR b.n - f.last >= 4 THEN b.n ELSE f.last END", "take": "f.last IS NULL OR b.n - f.last >= 4"}, ["kf_id"], "SELECT run, kf_id FROM o WHERE take")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    nth = A.track(spark, d).withColumn("n", F.row_number().over(w).cast("long")).filter("n % 2 = 0")
    return O.cooldown_select(nth, ["run"], ["n", "kf_id"], "n", 4)


#: Rows of whole runs that are worked on at once; a longer run goes by itself.
BLOCK = 1 << 15


def _per_run(f, out: str):
    """f over blocks of whole runs, poses in order, as numpy: rows, poses and where each run starts.

    Steps within a run follow each other; the same step of all runs of a block is one array.
    """

    def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        yaw = np.radians(rows["kf_id"].to_numpy() % 360)
        zero = np.zeros(len(rows))
        poses = np.stack([zero, zero, np.sin(yaw / 2), np.cos(yaw / 2), rows["x"].to_numpy() / 100, rows["y"].to_numpy() / 100, zero], axis=1)
        own = rows["run"].to_numpy()
        return f(rows, poses, np.flatnonzero(np.append(True, own[1:] != own[:-1])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            own = batch["run"].to_numpy()
            cut = int(np.argmax(own == own[-1]))
            if n + cut >= BLOCK and (cut or held[-1]["run"].iloc[-1] != own[0]):
                yield block([*held, batch.iloc[:cut]])
                held, n, batch = [], 0, batch.iloc[cut:]
            held.append(batch)
            n += len(batch)
        if held:
            yield block(held)

    def query(spark, d):
        return rounded(A.track(spark, d).repartition("run").sortWithinPartitions("run", "t", "kf_id").mapInPandas(run, out), 5)

    return query


def _steps(n: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, rows): the second row of each run, then the third of each that has one, and so on."""
    size = np.diff(np.append(starts, n))
    runs = np.arange(len(starts))
    for i in range(1, size.max()):
        runs = runs[size[runs] > i]
        yield runs, starts[runs] + i


def _carried(poses: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, rows, covariances): the covariance of each run's chain up to these rows, in their own frames."""
    back = np.zeros((len(poses), 6, 6))
    back[1:] = manifold.adjoint(manifold.inverse(manifold.compose(manifold.inverse(poses[:-1]), poses[1:])))
    cov = np.zeros((len(starts), 6, 6))
    for runs, at in _steps(len(poses), starts):
        cov[runs] = back[at] @ cov[runs] @ back[at].transpose(0, 2, 1) + np.eye(6) * 1e-4
        yield runs, at, cov[runs]


def _relative_cov(rows, poses, starts):
    o = np.zeros((len(poses), 2))
    for _, at, cov in _carried(poses, starts):
        o[at] = np.stack([np.trace(cov[:, k : k + 3, k : k + 3], axis1=1, axis2=2) for k in (0, 3)], axis=1)
    return pd.DataFrame({"run": rows["run"].to_numpy(), "kf_id": rows["kf_id"].to_numpy(), "trans": o[:, 0], "rot": o[:, 1]})


section.add("relative_cov_compose")(_per_run(_relative_cov, "run long, kf_id long, trans double, rot double"))


#: How many poses lie between the ends of the segments whose covariances are asked for, as between those of a loop of the graph queries.
SEGMENT = 3


def _between(poses, cov, a, b):
    """Covariances of the chain from rows a to rows b of the same run, in the frame of b; nan where a isn't before b or isn't known (-1).

    ``cov`` are those from each run's start. Both ends share the chain up to a, so what is left is the segment's own.
    """
    out = np.full((len(b), 6, 6), np.nan)
    at = np.flatnonzero((a >= 0) & (a < b))
    a, b = a[at], b[at]
    carry = manifold.adjoint(manifold.inverse(manifold.compose(manifold.inverse(poses[a]), poses[b])))
    out[at] = manifold.psd_clamp(cov[b] - carry @ cov[a] @ carry.transpose(0, 2, 1))
    return out


def _chain_cov(rows, poses, starts):
    """Of each run's chain the covariance's trace up to the last pose, and for each pose that of the segment from the one three before it, or null."""
    cov = np.zeros((len(poses), 6, 6))
    for _, at, of in _carried(poses, starts):
        cov[at] = of
    size = np.diff(np.append(starts, len(poses)))
    i, place = np.arange(len(poses)), np.arange(len(poses)) - np.repeat(starts, size)
    segment = np.round(np.trace(_between(poses, cov, np.where(place >= SEGMENT, i - SEGMENT, -1), i), axis1=1, axis2=2), 5) + 0.0
    listed = [None if v != v else v for v in segment.tolist()]
    # the first pose is certain
    last = np.trace(manifold.psd_clamp(cov[starts + size - 1]), axis1=1, axis2=2)
    return pd.DataFrame({"run": rows["run"].to_numpy()[starts], "n": size, "trace": last, "between": [listed[k : k + n] for k, n in zip(starts.tolist(), size.tolist(), strict=True)]})


section.add("chain_cov")(_per_run(_chain_cov, "run long, n long, trace double, between array<double>"))


def _gyro_bias(rows, poses, starts):
    bias, out = np.zeros((len(starts), 3)), np.zeros(len(poses))
    for runs, at in _steps(len(poses), starts):
        guess = manifold.boxplus(poses[at - 1], np.concatenate([np.zeros((len(at), 3)), bias[runs]], axis=1))
        bias[runs] = np.clip(bias[runs] + 0.05 * manifold.log(manifold.compose(manifold.inverse(poses[at]), guess))[:, 3:], -0.1, 0.1)
        out[at] = bias[runs, 2]
    return pd.DataFrame({"run": rows["run"].to_numpy(), "kf_id": rows["kf_id"].to_numpy(), "bias_z": out})


section.add("gyro_bias_observer")(_per_run(_gyro_bias, "run long, kf_id long, bias_z double"))

# --- ordering, limits, bounded state


@section.add("sort_by_offset", with_views("SELECT scan_id, idx, row_number() OVER (PARTITION BY scan_id ORDER BY t_offset, idx) AS place FROM v_point"))
def _(spark, d):
    return A.point(spark, d).select("scan_id", "idx", F.row_number().over(Window.partitionBy("scan_id").orderBy("t_offset", "idx")).alias("place"))


@section.add("topk_candidates", with_views("SELECT q, id, rank FROM (SELECT run AS q, kf_id AS id, CAST(row_number() OVER (PARTITION BY run ORDER BY x / 500, kf_id) AS INT) AS rank FROM v_track WHERE x / 500 < 0.7) WHERE rank <= 3"))
def _(spark, d):
    return place.topk_candidates(A.track(spark, d).select(col("run").alias("q"), col("kf_id").alias("id"), (col("x") / 500).alias("distance")), 3, 0.7).select("q", "id", "rank")


@section.add("topk_stages", "SELECT user_id, round(avg(value), 6) AS avg_ms FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 16")
def _(spark, d):
    return rounded(A.table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("avg_ms")).orderBy(col("avg_ms").desc(), "user_id").limit(16))


@section.add("distinct_sorted_keys", with_views("SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(y / 4) AS BIGINT) AS cy, CAST(floor(z / 4) AS BIGINT) AS cz FROM v_point ORDER BY 1, 2, 3"))
def _(spark, d):
    from posegrid.operators.joins import cells

    return cells(A.point(spark, d), 4.0).select("cx", "cy", "cz").distinct().orderBy("cx", "cy", "cz")


CELLS = "c AS (SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(y / 4) AS BIGINT) AS cy FROM v_point)"


@section.add("prune_far", with_views("SELECT cx, cy FROM c WHERE pow((cx+0.5)*4 - 25, 2) + pow((cy+0.5)*4 - 25, 2) <= 400", CELLS))
def _(spark, d):
    from posegrid.operators.joins import cells

    c = cells(A.point(spark, d), 4.0).select("cx", "cy").distinct()
    return c.filter(F.pow((col("cx") + 0.5) * 4 - 25, F.lit(2.0)) + F.pow((col("cy") + 0.5) * 4 - 25, F.lit(2.0)) <= 400)


@section.add("hot_window", with_views("SELECT cx, cy FROM c WHERE (cx+0.5)*4 BETWEEN 10 AND 30 AND (cy+0.5)*4 BETWEEN 5 AND 45", CELLS))
def _(spark, d):
    from posegrid.operators.joins import cells

    return cells(A.point(spark, d), 4.0).select("cx", "cy").distinct().filter("(cx+0.5)*4 between 10 and 30 and (cy+0.5)*4 between 5 and 45")


# --- set operations


@section.add("union_streams", "SELECT 'imu' AS tag, event_id, value, NULL::BIGINT AS key FROM events WHERE event_type = 'click' UNION ALL SELECT 'order', o_orderkey, o_totalprice, o_custkey FROM orders")
def _(spark, d):
    a = A.table(spark, d, "events").filter("event_type = 'click'").select(F.lit("imu").alias("tag"), "event_id", "value")
    b = A.table(spark, d, "orders").select(F.lit("order").alias("tag"), col("o_orderkey").alias("event_id"), col("o_totalprice").alias("value"), col("o_custkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True).select("tag", "event_id", "value", "key")


@section.add("union_backend_items", with_views("SELECT run, id, kind, row_number() OVER (PARTITION BY run ORDER BY t, kind, id) AS seq FROM (SELECT run, kf_id AS id, t, 'keyframe' AS kind FROM v_track UNION ALL SELECT run, kf_id, t, 'loop' FROM v_track WHERE x > 300 UNION ALL SELECT run, kf_id, t + 1, 'gnss' FROM v_track WHERE y > 500)"))
def _(spark, d):
    t = A.track(spark, d).select("run", col("kf_id").alias("id"), "t", "x", "y")
    items = t.withColumn("kind", F.lit("keyframe")).union(t.filter("x > 300").withColumn("kind", F.lit("loop"))).union(t.filter("y > 500").withColumn("t", col("t") + 1).withColumn("kind", F.lit("gnss")))
    return items.select("run", "id", "kind", F.row_number().over(Window.partitionBy("run").orderBy("t", "kind", "id")).alias("seq"))


OWN = "p AS (SELECT scan_id % 16 AS owner, CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy FROM v_point)"


def provenance(spark, d):
    return A.point(spark, d).select((col("scan_id") % 16).alias("owner"), F.floor(col("x") / 10).alias("cx"), F.floor(col("y") / 10).alias("cy"))


@section.add("provenance_append", with_views("SELECT owner, cx, cy, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT * FROM p WHERE owner < 4) GROUP BY 1, 2, 3", OWN))
def _(spark, d):
    p = provenance(spark, d)
    return p.unionAll(p.filter("owner < 4")).groupBy("owner", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@section.add("clear_keyframes", with_views("SELECT DISTINCT cx, cy FROM p WHERE (cx, cy) NOT IN (SELECT (cx, cy) FROM p WHERE owner = 3)", OWN))
def _(spark, d):
    p = provenance(spark, d)
    return p.select("cx", "cy").distinct().join(p.filter("owner = 3").select("cx", "cy"), ["cx", "cy"], "left_anti")


@section.add("shift_set", with_views("SELECT id, CAST(list_sort(list_distinct([((id % 8) + s + 8) % 8 for s in [-2, -1, 0, 1, 2, 6]])) AS VARCHAR) AS shifts FROM v_descriptor"))
def _(spark, d):
    s = F.array_sort(F.array_distinct(F.transform(F.array(*map(F.lit, (-2, -1, 0, 1, 2, 6))), lambda k: F.pmod(col("id") % 8 + k, F.lit(8)))))
    return A.descriptor(spark, d).select("id", F.concat(F.lit("["), F.array_join(F.transform(s, lambda x: x.cast("string")), ", "), F.lit("]")).alias("shifts"))


@section.add("rebuild_closure", with_views("SELECT DISTINCT run FROM b WHERE EXISTS (SELECT 1 FROM b m WHERE m.run % 40 = 0 AND b.ax - 5 <= m.bx AND b.bx + 5 >= m.ax AND b.ay - 5 <= m.by_ AND b.by_ + 5 >= m.ay)", "b AS (SELECT run, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM v_track WHERE y < 300 GROUP BY 1)"))
def _(spark, d):
    from posegrid.operators.mapping import rebuild_closure

    b = A.track(spark, d).filter("y < 300").groupBy(col("run").alias("id")).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    return rebuild_closure(b, b.filter("id % 40 = 0"), 5.0, 50.0).select(col("id").alias("run"))
