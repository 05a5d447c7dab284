"""Queries of sources, sinks, codecs and streams."""

from __future__ import annotations

import uuid

from posegrid import adapters as A
from posegrid.adapters import with_views
from posegrid.functions.geometry import TURBO
from posegrid.operators.folds import fold_sql
from posegrid.sources import codecs
from posegrid.sources.packet_log import PacketLog
from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Section, rounded

section = Section()
col = F.col


def scratch(spark) -> str:
    """A new folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/posegrid-{uuid.uuid4().hex}"


@section.add("source_replay", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) <= 864000000000")
def _(spark, d):
    s = A.sensor(spark, d)
    start = s.agg(F.min("stamp_us").alias("t0"))
    return s.filter("modality in ('imu', 'lidar')").join(F.broadcast(start)).filter("stamp_us - t0 <= 864000000000").select("event_id")


@section.add("decode_points", with_views("SELECT scan_id, idx, round(x / 1000, 6) AS x, coalesce(CASE WHEN idx % 3 = 0 THEN intensity END, CASE WHEN idx % 3 = 1 THEN z END, y) AS intensity, t_offset - min(t_offset) OVER (PARTITION BY scan_id) AS t_offset, 1000 * scan_id + min(t_offset) OVER (PARTITION BY scan_id) AS stamp FROM v_point"))
def _(spark, d):
    p = A.point(spark, d)
    raw = p.select("scan_id", "idx", "x", "y", "z", F.when(col("idx") % 3 == 0, col("intensity")).alias("intensity"), F.when(col("idx") % 3 == 1, col("z")).alias("signal"), col("y").alias("reflectivity"), col("t_offset").alias("t"), (col("scan_id") * 1000).alias("stamp"))
    return codecs.decode_points(raw).select("scan_id", "idx", F.round("x", 6).alias("x"), "intensity", "t_offset", "stamp")


@section.add("decode_imu", with_views("SELECT event_id, stamp_us * 1000 AS stamp_ns, value AS ax, CAST(k AS DOUBLE) AS gx FROM v_sensor WHERE modality = 'imu'"))
def _(spark, d):
    return A.modality(spark, d, "imu").select("event_id", (col("stamp_us") * 1000).alias("stamp_ns"), col("value").alias("ax"), col("k").cast("double").alias("gx"))


@section.add("decode_gnss", with_views("SELECT id, CASE WHEN fix_rank - 1 < 0 THEN 'none' WHEN fix_rank = 1 THEN 'spp' ELSE 'dgps' END AS fix FROM v_geo"))
def _(spark, d):
    return codecs.decode_gnss(A.geo(spark, d).withColumn("status", col("fix_rank") - 1)).select("id", "fix")


#: Raw frames of two by three pixels in rows of eight bytes, out of the events' own text; each seventh is cut short.
FRAMES = """f AS (SELECT event_id, k, CASE k % 5 WHEN 0 THEN 'bgr8' WHEN 1 THEN 'rgb8' WHEN 2 THEN 'mono8' WHEN 3 THEN 'bayer_rggb8' ELSE 'other' END AS encoding,
    CASE WHEN event_id % 7 = 0 THEN 'short' ELSE rpad(event_id || '-' || props, 24, '#')[1:24] END AS data FROM v_sensor JOIN (SELECT event_id, props FROM events) USING (event_id) WHERE modality = 'camera')"""


def frames(spark, d):
    e = A.table(spark, d, "events").select("event_id", "props")
    text = F.concat_ws("-", col("event_id").cast("string"), "props")
    data = F.when(col("event_id") % 7 == 0, "short").otherwise(F.rpad(text, 24, "#"))
    kind = F.when(col("k") % 5 == 0, "bgr8").when(col("k") % 5 == 1, "rgb8").when(col("k") % 5 == 2, "mono8").when(col("k") % 5 == 3, "bayer_rggb8").otherwise("other")
    return A.modality(spark, d, "camera").join(e, "event_id").select("event_id", "k", F.encode(data, "utf-8").alias("data"), F.lit(2).alias("width"), F.lit(3).alias("height"), F.lit(8).alias("step"), kind.alias("encoding"))


PIXELS = """CASE WHEN length(data) < 24 OR encoding = 'other' THEN NULL WHEN encoding IN ('mono8', 'bayer_rggb8') THEN data[1:2] || data[9:10] || data[17:18] WHEN encoding = 'rgb8' THEN data[1:6] || data[9:14] || data[17:22]
    ELSE reverse(data[1:3]) || reverse(data[4:6]) || reverse(data[9:11]) || reverse(data[12:14]) || reverse(data[17:19]) || reverse(data[20:22]) END"""


@section.add("decode_image", with_views(f"SELECT event_id, hex({PIXELS}) AS pixels FROM f", FRAMES))
def _(spark, d):
    """Frames with row padding in five encodings; one isn't known, and some are shorter than they say."""
    return codecs.decode_image(frames(spark, d)).select("event_id", F.hex("pixels").alias("pixels"))


@section.add("decode_image_compressed", with_views("SELECT event_id, CAST(CASE WHEN length(data) = 24 THEN 8 END AS INT) AS width, CAST(CASE WHEN length(data) = 24 THEN 3 END AS INT) AS height, CASE WHEN length(data) = 24 THEN hex(data) END AS pixels FROM f", FRAMES))
def _(spark, d):
    """The same bytes as grey PNG files of eight by three pixels, decoded again; those cut short are no images."""
    png = F.pandas_udf(lambda s: s.map(lambda b: codecs.png(b, 8, 3) if len(b) == 24 else b), "binary")
    raw = frames(spark, d).select("event_id", png("data").alias("data"))
    return codecs.decode_image_compressed(raw).select("event_id", "image.width", "image.height", F.hex("image.pixels").alias("pixels"))


def _poses(spark, d):
    return A.track(spark, d).select("run", (col("t") / 1e6).alias("stamp"), col("x").alias("tx"), col("y").alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"))


TUM = "SELECT run, round(t / 1e6, 6) AS stamp, round(x, 6) AS tx, round(y, 6) AS ty FROM (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY t, x, y) AS gap FROM v_track) WHERE gap IS NULL OR gap > 1"


@section.add("read_tum", with_views(TUM))
def _(spark, d):
    lines = _poses(spark, d)
    text = lines.select("run", F.concat_ws(" ", F.format_string("%.6f", "stamp"), *[F.format_string("%.9f", col(c)) for c in codecs.POSE]).alias("value"))
    noise = lines.select("run", F.lit("# stamp tx ty tz").alias("value")).distinct().union(lines.select("run", F.lit("1.0 2.0 3.0").alias("value")).distinct())
    return rounded(codecs.parse_tum(text.union(noise), ["run"]).select("run", "stamp", "tx", "ty"))


@section.add("write_tum", with_views("SELECT count(*) AS n, round(sum(x), 3) AS sx FROM v_track"))
def _(spark, d):
    path = scratch(spark)
    codecs.write_tum(_poses(spark, d), path)
    return codecs.tum_rows(spark.read.text(path)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tx"), 3).alias("sx"))


@section.add("corrected_trajectory_sink", with_views("SELECT kf_id, round(t / 1e6, 6) AS stamp, round(x, 6) AS tx, round(y, 6) AS ty FROM v_track ORDER BY kf_id"))
def _(spark, d):
    return rounded(A.track(spark, d).select("kf_id", (col("t") / 1e6).alias("stamp"), col("x").alias("tx"), col("y").alias("ty"))).orderBy("kf_id")


@section.add("packet_index", with_views("SELECT 'kf' AS record, kf_id AS id, t * 1000 AS stamp_ns, NULL::BIGINT AS to_id, round(x, 6) AS tx, round(y, 6) AS ty, kf_id - 1 AS rel_to, 'between' AS kind FROM v_track UNION ALL SELECT 'loop', kf_id, NULL, kf_id + 7, NULL, NULL, NULL, NULL FROM v_track WHERE x > 300"))
def _(spark, d):
    t = A.track(spark, d)
    kf = t.select(F.concat_ws(" ", F.lit("kf"), "kf_id", (col("t") * 1000).cast("string"), F.format_string("%.9f", "x"), F.format_string("%.9f", "y"), F.lit("0 0 0 0 1"), (col("kf_id") - 1).cast("string"), F.lit("between")).alias("value"))
    loops = t.filter("x > 300").select(F.concat_ws(" ", F.lit("loop"), "kf_id", (col("kf_id") + 7).cast("string")).alias("value"))
    cut = t.limit(1).select(F.lit("kf 12 3").alias("value"))  # a truncated line
    return rounded(codecs.parse_packet_index(kf.union(loops).union(cut)).select("record", "id", "stamp_ns", "to_id", "tx", "ty", "rel_to", "kind"))


@section.add("packet_log_read", with_views("SELECT 'keyframe' AS kind, kf_id AS id, t * 1000 AS stamp_ns, round(x, 9) AS tx, round(y, 9) AS ty FROM v_track"))
def _(spark, d):
    """Written by the data source and read back."""
    spark.dataSource.register(PacketLog)
    path = scratch(spark)
    rows = A.track(spark, d).select(F.lit("keyframe").alias("kind"), col("kf_id").alias("id"), (col("t") * 1000).alias("stamp_ns"), col("x").alias("tx"), col("y").alias("ty"), *[F.lit(v).alias(n) for n, v in (("tz", 0.0), ("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    rows.write.format("packetlog").mode("append").save(path)
    return rounded(spark.read.format("packetlog").load(path).select("kind", "id", "stamp_ns", "tx", "ty"), 9)


section.queries["packet_log_write"], section.sql["packet_log_write"] = section.queries["packet_log_read"], section.sql["packet_log_read"]


@section.add("loops_read", with_views("SELECT run AS from_id, kf_id AS to_id, CASE WHEN kf_id % 2 = 0 THEN round(x / 500 + 1e-9, 6) ELSE 0.8 END AS fitness, greatest(run, kf_id) AS at_kf, round(CASE WHEN kf_id % 3 = 0 THEN 0.5 END, 6) AS c11, kf_id % 5 = 0 AS outlier FROM v_track"))
def _(spark, d):
    t = A.track(spark, d)
    j = t.select(col("run").alias("from_id"), col("kf_id").alias("to_id"), F.when(col("kf_id") % 2 == 0, F.round(col("x") / 500 + 1e-9, 6)).alias("fitness"), F.when(col("kf_id") % 3 == 0, F.array(*[F.lit(v) for v in (0.1, 0.5, 0.1, 0.1, 0.1, 0.1)])).alias("cov_diag"), F.when(col("kf_id") % 5 == 0, True).alias("outlier"))
    return codecs.parse_loops(codecs.loop_lines(j)).select("from_id", "to_id", "fitness", "at_kf", F.get("cov", F.lit(7)).alias("c11"), "outlier")


@section.add("loops_yaml_read", with_views("SELECT run AS from_id, kf_id AS to_id, round(x / 10, 6) AS tx, round(y / 1000, 6) AS ty, CASE WHEN kf_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS qz, CASE WHEN kf_id % 2 = 0 THEN round(x / 500 + 1e-9, 6) ELSE 0.8 END AS fitness, greatest(run, kf_id) AS at_kf, CASE WHEN kf_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS c7, kf_id % 5 = 0 AS outlier FROM v_track"))
def _(spark, d):
    """Loops written as YAML files and read again; some with the whole covariance, without fitness or mark, and quaternions of any length."""
    path = scratch(spark)
    k = col("kf_id")
    number = lambda c: F.round(c, 6)
    turn = F.when(k % 2 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.6), F.lit(0.8)))
    whole = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.when(i % 7 == 0, 0.25).otherwise(0.0)))
    diagonal = F.when(k % 3 == 0, F.array(*[F.lit(v) for v in (0.1, 0.5, 0.1, 0.1, 0.1, 0.1)]))
    j = A.track(spark, d).select(
        col("run").alias("from_id"), k.alias("to_id"), F.array(number(col("x") / 10), number(col("y") / 1000), F.lit(0.0)).alias("t"), turn.alias("q"), whole.alias("cov"), diagonal.alias("cov_diag"),
        F.when(k % 2 == 0, number(col("x") / 500 + 1e-9)).alias("fitness"), F.lit(None).cast("long").alias("at_kf"), F.when(k % 5 == 0, True).alias("outlier"),
    )
    codecs.write_loops_yaml(j, f"{path}/loops")
    got = codecs.read_loops_yaml(spark, f"{path}/loops").filter("problem is null")
    return rounded(got.select("from_id", "to_id", col("t")[0].alias("tx"), col("t")[1].alias("ty"), col("q")[2].alias("qz"), "fitness", "at_kf", col("cov")[7].alias("c7"), "outlier"))


@section.add("calib_snapshot", "SELECT l_suppkey AS sensor, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS offset_x FROM lineitem GROUP BY 1")
def _(spark, d):
    version = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return A.table(spark, d, "lineitem").groupBy(col("l_suppkey").alias("sensor")).agg(F.max_by("l_quantity", version).alias("offset_x"))


def _blocks(spark, d, *fields):
    return A.sensor(spark, d).select(F.concat_ws("\n", *[f if not isinstance(f, str) else F.lit(f) for f in fields]).alias("value"))


@section.add("telemetry_parse", with_views("SELECT stamp_us AS stamp, modality AS key, round(value, 6) AS v0, CAST(k AS DOUBLE) AS v1 FROM v_sensor"))
def _(spark, d):
    b = _blocks(spark, d, F.concat(F.lit("stamp: "), col("stamp_us").cast("string")), F.concat(F.lit("key: "), col("modality")), F.concat(F.lit("values: ["), F.format_string("%.9f", "value"), F.lit(", "), col("k").cast("string"), F.lit("]")))
    zero = b.limit(1).select(F.lit("stamp: 0\nkey: a\nvalues: [1]").alias("value"))
    return rounded(codecs.parse_telemetry(b.union(zero)).select("stamp", "key", F.get("values", F.lit(0)).alias("v0"), F.get("values", F.lit(1)).alias("v1")))


@section.add("stage_timing_parse", with_views("SELECT stamp_us AS stamp, modality AS stage, round(value, 6) AS ms FROM v_sensor"))
def _(spark, d):
    b = _blocks(spark, d, F.concat(F.lit("stamp: "), col("stamp_us").cast("string")), F.concat(F.lit("stage: "), col("modality")), F.concat(F.lit("ms: "), F.format_string("%.9f", "value")))
    return rounded(codecs.parse_stage_timing(b))


@section.add("events_parse", with_views("SELECT stamp_us AS stamp, k % 4 AS level, modality AS tag, 'id ' || event_id AS message FROM v_sensor"))
def _(spark, d):
    b = _blocks(spark, d, F.concat(F.lit("stamp: "), col("stamp_us").cast("string")), F.concat(F.lit("level: "), (col("k") % 4).cast("string")), F.concat(F.lit("tag: "), col("modality")), F.concat(F.lit("message: 'id "), col("event_id").cast("string"), F.lit("'")))
    return codecs.parse_events(b)


_ZEROS = "0.000000000 0.000000000 0.000000000"


@section.add(
    "g2o_export",
    with_views(
        f"""SELECT 'VERTEX_SE3:QUAT ' || kf_id || printf(' %.9f %.9f ', x, y) || '0.000000000 {_ZEROS} 1.000000000' AS value FROM v_track UNION ALL
        SELECT 'EDGE_SE3:QUAT ' || kf_id || ' ' || b || printf(' %.9f %.9f ', bx - x, by_ - y) || '0.000000000 {_ZEROS} 1.000000000 10000.000 0 0 0 0 0 10000.000 0 0 0 0 10000.000 0 0 0 10000.000 0 0 10000.000 0 10000.000' FROM
        (SELECT *, lead(kf_id) OVER w AS b, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id)) WHERE b IS NOT NULL"""
    ),
)
def _(spark, d):
    """Keyframes as vertices under their own ids, and the steps of each run as edges between them."""
    t = A.track(spark, d)
    zero = F.lit(0.0)
    pose = lambda x, y: [x.alias("tx"), y.alias("ty"), zero.alias("tz"), zero.alias("qx"), zero.alias("qy"), zero.alias("qz"), F.lit(1.0).alias("qw")]
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    ends = t.select(col("kf_id").alias("a"), F.lead("kf_id").over(w).alias("b"), *pose(F.lead("x").over(w) - col("x"), F.lead("y").over(w) - col("y")))
    return codecs.g2o_lines(t.select(col("kf_id").alias("id"), *pose(col("x"), col("y"))), ends.filter("b is not null").withColumn("information", F.lit(1e4)))


@section.add("cloud_encode", with_views("SELECT scan_id, idx, (CAST(round(r * 255) AS INT) << 16) | (CAST(round(g * 255) AS INT) << 8) | CAST(round(b * 255) AS INT) AS rgb FROM (SELECT scan_id, idx, " + ", ".join("greatest(0, least(1, " + " + ".join(f"({k!r}) * pow(c, {i})" for i, k in enumerate(ch)) + f")) AS {n}" for n, ch in zip("rgb", TURBO, strict=True)) + " FROM (SELECT scan_id, idx, CASE WHEN max(z) OVER w > min(z) OVER w THEN (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) ELSE 0.5 END AS c FROM v_point WINDOW w AS (PARTITION BY scan_id)))"))
def _(spark, d):
    return codecs.cloud_encode(A.point(spark, d), ["scan_id"], "z").select("scan_id", "idx", "rgb")


@section.add("sweep_telemetry", with_views("SELECT scan_id, count(*) AS n_points, round(avg(x), 6) AS mean_x, round(max(intensity), 6) AS max_intensity, max(t_offset) AS last_offset FROM v_point GROUP BY 1"))
def _(spark, d):
    return rounded(A.point(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("mean_x"), F.max("intensity").alias("max_intensity"), F.max("t_offset").alias("last_offset")))


@section.add("path_aggregate", with_views("SELECT run, CAST(list(kf_id ORDER BY t, kf_id) AS VARCHAR) AS path FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t DESC, kf_id DESC) AS n FROM v_track) WHERE n <= 6 GROUP BY 1"))
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("run").orderBy(col("t").desc(), col("kf_id").desc()))
    last = A.track(spark, d).withColumn("n", n).filter("n <= 6")
    path = F.transform(F.array_sort(F.collect_list(F.struct("t", "kf_id"))), lambda r: r["kf_id"].cast("string"))
    return last.groupBy("run").agg(F.concat(F.lit("["), F.array_join(path, ", "), F.lit("]")).alias("path"))


@section.add("odometry_messages")
def _(spark, d):
    """Pose, transform and marker messages as projections."""
    p = _poses(spark, d)
    return rounded(p.select("run", "stamp", F.lit("map").alias("frame"), F.lit("body").alias("child"), F.struct("tx", "ty", "tz").alias("position").getField("tx").alias("px"), F.concat(F.lit("m"), col("run").cast("string")).alias("marker")))


@section.add("control_services", with_views("SELECT event_id FROM v_sensor WHERE modality IN ('imu', 'gnss')"))
def _(spark, d):
    control = spark.createDataFrame([("imu", True), ("gnss", True), ("lidar", False)], "modality string, enabled boolean")
    return A.sensor(spark, d).join(F.broadcast(control.filter("enabled")), "modality", "left_semi").select("event_id")


#: A few settings of each customer's configuration; the others keep their defaults.
GIVEN = {
    "map.tsdf_voxel_m": "0.05 + (id % 10) * 0.05", "backend.pcm_chi2_alpha": "(id % 21) / 20.0D", "place.pcm_chi2_conf": "CASE WHEN id % 4 = 0 THEN 0.99D ELSE (id % 21) / 20.0D END", "preprocess.lidar.blind": "CAST(id % 150 AS DOUBLE)",
    "sensors.camera.shutter": "CASE WHEN id % 9 = 0 THEN 'rolling' END", "frontend.lio.min_keypoints": "id % 4", "aggregation.max_wait_ms": "CAST(id % 300 AS DOUBLE)", "time.source": "CASE WHEN id % 6 = 0 THEN 'ptp' END", "sensors.lidar.ptp": "id % 12 = 0",
}
_G = {k: v.replace("20.0D", "20.0::DOUBLE").replace("0.99D", "0.99::DOUBLE") for k, v in GIVEN.items()}
_RULES = {
    "frontend.lio.min_keypoints must be 1 or more": f"{_G['frontend.lio.min_keypoints']} >= 1",
    "backend.pcm_chi2_alpha must lie in (0, 1)": f"{_G['backend.pcm_chi2_alpha']} > 0 AND {_G['backend.pcm_chi2_alpha']} < 1", "place.pcm_chi2_conf must lie in (0, 1)": f"{_G['place.pcm_chi2_conf']} > 0 AND {_G['place.pcm_chi2_conf']} < 1",
    "sensors.camera.shutter must be one of global": "id % 9 <> 0", "map.tsdf_voxel_m must be at most preprocess.lidar.voxel_surf_m": f"{_G['map.tsdf_voxel_m']} <= 0.4", "map.tsdf_voxel_m must be at most map.reg_voxel_m": f"{_G['map.tsdf_voxel_m']} <= 0.5",
    "place.pcm_chi2_conf must equal backend.pcm_chi2_alpha": f"{_G['place.pcm_chi2_conf']} = {_G['backend.pcm_chi2_alpha']}", "preprocess.lidar.blind must be below preprocess.lidar.det_range": "id % 150 < 120",
    "aggregation.max_wait_ms must be one lidar period at least": "id % 300 >= 100", "time.source ptp needs a sensor with ptp": "id % 6 <> 0 OR id % 12 = 0",
}


def _configs(spark, d):
    """Each customer's configuration as nested JSON text."""
    parts: dict = {}
    for name, sql in GIVEN.items():
        *path, last = name.split(".")
        here = parts
        for p in path:
            here = here.setdefault(p, {})
        here[last] = F.expr(sql)
    nest = lambda x: F.struct(*[(nest(v) if isinstance(v, dict) else v).alias(k) for k, v in x.items()])
    return A.geo(spark, d).select("id", F.to_json(nest(parts)).alias("text"))


@section.add("config_load", with_views(f"SELECT id, round(CAST({_G['map.tsdf_voxel_m']} AS DOUBLE), 6) AS voxel, CAST(id % 150 AS DOUBLE) AS blind, CASE WHEN id % 9 = 0 THEN 'rolling' ELSE 'global' END AS shutter, CASE WHEN id % 6 = 0 THEN 'ptp' ELSE 'host' END AS source, id % 12 = 0 AS ptp, 100 AS rounds, 120.0::DOUBLE AS det_range FROM v_geo"))
def _(spark, d):
    """Settings of each configuration: those that it names, and defaults for all others."""
    from posegrid import settings

    names = {"map.tsdf_voxel_m": "voxel", "preprocess.lidar.blind": "blind", "sensors.camera.shutter": "shutter", "time.source": "source", "sensors.lidar.ptp": "ptp", "frontend.lio.icp_max_iterations": "rounds", "preprocess.lidar.det_range": "det_range"}
    return rounded(settings.resolved(_configs(spark, d), "text").select("id", *[col(f"`{k}`").alias(v) for k, v in names.items()]))


@section.add("config_validate", with_views("SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN '{m}' END" for m, c in _RULES.items()) + "], lambda m: m IS NOT NULL), '; ') AS broken FROM v_geo"))
def _(spark, d):
    """All rules that each configuration breaks."""
    from posegrid import settings

    known = settings.resolved(_configs(spark, d), "text")
    return known.select("id", F.concat_ws("; ", settings.broken(known)).alias("broken"))


# --- streams: files of the sensor table are read as they would arrive


def _stream(spark, d, path: str):
    """The sensor table as a stream; it is written once in a few files first, since a table may be one file."""
    s = A.sensor(spark, d).select((col("sensor_id") % 4).cast("long").alias("rig"), "modality", "stamp_us", "event_id").filter("modality <> 'fault'")
    s.repartitionByRange(4, "stamp_us").sortWithinPartitions("stamp_us").write.parquet(f"{path}/in")
    return spark.readStream.schema(s.schema).parquet(f"{path}/in")


RIG = "(SELECT *, sensor_id % 4 AS rig FROM v_sensor WHERE modality <> 'fault')"
ALIGNED = (
    f"r AS {RIG}",
    f"w AS (SELECT rig, event_id AS sweep_id, stamp_us AS b, stamp_us + {A.SWEEP_US} AS e, least(stamp_us, coalesce(lag(stamp_us + {A.SWEEP_US}) OVER (PARTITION BY rig ORDER BY stamp_us, event_id), stamp_us)) AS lower FROM r WHERE modality = 'lidar')",
    "i AS (SELECT w.rig, sweep_id, count(*) AS n FROM w JOIN r ON r.rig = w.rig AND modality = 'imu' AND stamp_us > lower AND stamp_us <= e GROUP BY 1, 2)",
    "z AS (SELECT w.rig, sweep_id, max(stamp_us) AS s, any_value(lower) AS lower FROM w JOIN r ON r.rig = w.rig AND modality = 'imu' AND stamp_us <= b GROUP BY 1, 2 HAVING max(stamp_us) <= any_value(lower))",
    "o AS (SELECT modality, event_id, stamp_us, rig, sweep_id FROM (SELECT r.*, w.sweep_id, row_number() OVER (PARTITION BY r.event_id ORDER BY w.b, w.sweep_id) AS place FROM w JOIN r ON r.rig = w.rig AND modality IN ('camera', 'gnss') AND stamp_us BETWEEN b AND e) WHERE place = 1)",
    "c AS (SELECT rig, sweep_id, arg_min(event_id, (stamp_us, event_id)) FILTER (modality = 'camera') AS image_id, count(*) FILTER (modality = 'gnss') AS n_gnss FROM o GROUP BY 1, 2)",
    "h AS (SELECT rig, max(stamp_us) AS newest FROM r WHERE modality = 'imu' GROUP BY 1)",
)


@section.add("stream_align", with_views("SELECT w.rig, w.sweep_id, coalesce(i.n, 0) + CASE WHEN z.s IS NULL THEN 0 ELSE 1 END AS n_imu, z.s AS straddler_stamp, image_id, coalesce(n_gnss, 0) AS n_gnss, coalesce(newest < e, true) AS late, 0 AS dropped FROM w LEFT JOIN i USING (rig, sweep_id) LEFT JOIN z USING (rig, sweep_id) LEFT JOIN c USING (rig, sweep_id) LEFT JOIN h USING (rig)", *ALIGNED))
def _(spark, d):
    """Measure groups of four rigs from a stream that ends; those of the last sweeps, which nothing covers any more, are late."""
    from posegrid.streaming import align

    path = scratch(spark)
    day = 24 * 3_600_000_000
    # as far apart as the table's files may lie
    rules = align.Rules(A.SWEEP_US, 40 * day, 40 * day, (), 400 * day)
    source = _stream(spark, d, path)
    # at the newest stamp, since rows that are older than the stream's watermark are dropped
    ends = A.sensor(spark, d).agg(F.max("stamp_us").alias("stamp_us")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("rig"), F.lit(align.END).alias("modality"), "stamp_us", F.lit(-1).cast("long").alias("event_id"))
    ends.filter("stamp_us is not null").coalesce(1).write.mode("append").parquet(f"{path}/in")
    with align.keyed_state(spark):
        query = align.fan_out(align.align(source, rules), f"{path}/cp", [align.parquet_sink(f"{path}/out"), align.null_sink()])
    query.awaitTermination()
    return spark.read.schema(align.OUT).parquet(f"{path}/out").drop("batch")


THROTTLED = "(SELECT modality || '-' || (sensor_id % 4) AS key, stamp_us, event_id FROM v_sensor WHERE modality <> 'fault')"
LATER = f"f.last IS NULL OR b.stamp_us - f.last >= {12 * 3_600_000_000}"
_sql, _ctes = fold_sql(THROTTLED, "key", "stamp_us, event_id", {"last": "CAST(NULL AS BIGINT)", "out_": "false"}, {"last": f"CASE WHEN {LATER} THEN b.stamp_us ELSE f.last END", "out_": LATER}, ["event_id", "stamp_us"], "SELECT key, stamp_us, event_id FROM o WHERE out_")


@section.add("stream_throttle", with_views(_sql, *_ctes, recursive=True))
def _(spark, d):
    from posegrid.streaming import align

    path = scratch(spark)
    s = _stream(spark, d, path).select(F.concat_ws("-", "modality", col("rig").cast("string")).alias("key"), "stamp_us", "event_id")
    align.fan_out(align.throttle(s, 12 * 3_600_000_000), f"{path}/cp", [align.parquet_sink(f"{path}/out")]).awaitTermination()
    return spark.read.schema("key string, stamp_us long, event_id long").parquet(f"{path}/out").select("key", "stamp_us", "event_id")


@section.add("stream_window_counts", with_views("SELECT modality, (stamp_us // 86400000000) * 86400000000 AS day_us, count(*) AS n FROM v_sensor WHERE modality <> 'fault' GROUP BY 1, 2"))
def _(spark, d):
    """Tumbling windows with a watermark; all windows are closed as the stream ends in complete mode."""
    path = scratch(spark)
    s = _stream(spark, d, path).withColumn("ts", F.timestamp_micros("stamp_us")).withWatermark("ts", "20 milliseconds")
    counts = s.groupBy("modality", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("modality", F.unix_micros("w.start").alias("day_us"), "n")
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
