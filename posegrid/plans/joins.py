"""Queries of joins."""

from __future__ import annotations

from posegrid import adapters as A
from posegrid.adapters import SWEEP_US, with_views
from posegrid.operators import joins as J
from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Section, rounded

section = Section()
LOWER = "b AS (SELECT *, least(t_begin, coalesce(lag(t_end) OVER (ORDER BY t_begin, sweep_id), t_begin)) AS lower FROM v_sweep)"
IMU = """i AS (SELECT sweep_id, event_id, stamp_us, false AS straddler FROM b JOIN v_sensor s ON s.modality = 'imu' AND s.stamp_us > b.lower AND s.stamp_us <= b.t_end
    UNION ALL SELECT sweep_id, event_id, stamp_us, true FROM (SELECT b.sweep_id, b.lower, s.event_id, s.stamp_us, row_number() OVER (PARTITION BY b.sweep_id ORDER BY s.stamp_us DESC, s.event_id DESC) AS r
    FROM b JOIN v_sensor s ON s.modality = 'imu' AND s.stamp_us <= b.t_begin) WHERE r = 1 AND stamp_us <= lower)"""
ONCE = "(SELECT event_id, stamp_us, sweep_id FROM (SELECT s.event_id, s.stamp_us, w.sweep_id, row_number() OVER (PARTITION BY s.event_id ORDER BY w.t_begin, w.sweep_id) AS r FROM v_sweep w JOIN v_sensor s ON s.modality = '{}' AND s.stamp_us BETWEEN w.t_begin AND w.t_end) WHERE r = 1)"


@section.add("sweep_imu_interval_join", with_views("SELECT * FROM i", "v_sweep_used AS (SELECT 1 FROM v_sweep)", LOWER, IMU))
def _(spark, d):
    return J.sweep_imu(A.sweep(spark, d), A.modality(spark, d, "imu"), SWEEP_US)


@section.add("sweep_image_join", with_views(f"SELECT sweep_id, arg_min(event_id, stamp_us) AS image_id FROM {ONCE.format('camera')} GROUP BY sweep_id"))
def _(spark, d):
    return J.sweep_image(A.sweep(spark, d), A.modality(spark, d, "camera"), SWEEP_US)


@section.add("sweep_gnss_join", with_views(f"SELECT event_id, stamp_us, sweep_id FROM {ONCE.format('gnss')}"))
def _(spark, d):
    return J.assigned_once(A.sweep(spark, d), A.modality(spark, d, "gnss"), SWEEP_US)


@section.add(
    "measure_group",
    with_views(
        f"""SELECT w.sweep_id, coalesce(n_imu, 0) AS n_imu, straddler_stamp, image_id, coalesce(n_gnss, 0) AS n_gnss, round(mean_value, 6) AS mean_value FROM v_sweep w
        LEFT JOIN (SELECT i.sweep_id, count(*) AS n_imu, max(CASE WHEN straddler THEN i.stamp_us END) AS straddler_stamp, avg(s.value) AS mean_value FROM i JOIN v_sensor s USING (event_id) GROUP BY 1) a USING (sweep_id)
        LEFT JOIN (SELECT sweep_id, arg_min(event_id, stamp_us) AS image_id FROM {ONCE.format("camera")} GROUP BY 1) c USING (sweep_id) LEFT JOIN (SELECT sweep_id, count(*) AS n_gnss FROM {ONCE.format("gnss")} GROUP BY 1) g USING (sweep_id)""",
        LOWER, IMU,
    ),
)
def measure_group(spark, d):
    m = {k: A.modality(spark, d, k) for k in ("imu", "camera", "gnss")}
    return rounded(J.measure_group(A.sweep(spark, d), m["imu"], m["camera"], m["gnss"], SWEEP_US))


def _sides(spark, d):
    """Estimated poses (clicks) and true ones (views) of each user."""
    return A.modality(spark, d, "imu").select("event_id", "user_id", "stamp_us"), A.modality(spark, d, "lidar").select("user_id", "stamp_us")


def _nearest_sql(where: str, tie: str) -> str:
    return with_views(f"""SELECT event_id, near_stamp, abs(stamp_us - near_stamp) AS gap FROM (SELECT l.event_id, l.stamp_us, r.stamp_us AS near_stamp, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.stamp_us - r.stamp_us), r.stamp_us {tie}) AS n
        FROM v_sensor l JOIN v_sensor r ON l.user_id = r.user_id AND l.modality = 'imu' AND r.modality = 'lidar') WHERE n = 1 {where}""")


HOUR = 3_600_000_000
for name, tolerance, closed, tie, where, order in (
    ("asof_nearest_two_pointer", 12 * HOUR, True, "earlier", f"AND abs(stamp_us - near_stamp) <= {12 * HOUR}", "ASC"),
    ("asof_nearest_bisect", 6 * HOUR, False, "later", f"AND abs(stamp_us - near_stamp) < {6 * HOUR}", "DESC"),
    ("asof_nearest_max_dt", 24 * HOUR, False, "earlier", f"AND abs(stamp_us - near_stamp) < {24 * HOUR}", "ASC"),
    ("asof_argmin_unbounded", None, True, "earlier", "", "ASC"),
):

    def _(spark, d, tolerance=tolerance, closed=closed, tie=tie):
        left, right = _sides(spark, d)
        return J.asof_nearest(left, right, "stamp_us", ["user_id"], tolerance, closed, tie).select("event_id", "near_stamp", "gap")

    section.add(name, _nearest_sql(where, order))(_)


@section.add(
    "bracket_join",
    with_views("""SELECT event_id, coalesce(a.i, b.i) AS before_id, coalesce(b.i, a.i) AS after_id, CASE WHEN a.i IS NULL OR b.i IS NULL THEN 0.0 ELSE round((l.stamp_us - a.s) / (b.s - a.s), 6) END AS beta FROM (SELECT * FROM v_sensor WHERE modality = 'gnss') l
        LEFT JOIN LATERAL (SELECT r.stamp_us AS s, r.event_id AS i FROM v_sensor r WHERE r.modality = 'lidar' AND r.user_id = l.user_id AND r.stamp_us <= l.stamp_us ORDER BY r.stamp_us DESC LIMIT 1) a ON true
        LEFT JOIN LATERAL (SELECT r.stamp_us AS s, r.event_id AS i FROM v_sensor r WHERE r.modality = 'lidar' AND r.user_id = l.user_id AND r.stamp_us > l.stamp_us ORDER BY r.stamp_us LIMIT 1) b ON true
        WHERE coalesce(a.i, b.i) IS NOT NULL"""),
)
def _(spark, d):
    keys = A.modality(spark, d, "lidar").select("user_id", "stamp_us", F.col("event_id").alias("kf"))
    return rounded(J.bracket_join(A.modality(spark, d, "gnss"), keys, "stamp_us", "kf", ["user_id"]).select("event_id", "before_id", "after_id", "beta"))


@section.add(
    "gnss_nearest_keyframe",
    with_views("SELECT g.event_id, k.event_id AS kf_id FROM (SELECT * FROM v_sensor WHERE modality = 'gnss') g ASOF JOIN (SELECT * FROM v_sensor WHERE modality = 'lidar') k ON g.stamp_us >= k.stamp_us"),
)
def _(spark, d):
    keys = A.modality(spark, d, "lidar").select("stamp_us", F.col("event_id").alias("kf_id"))
    return J.asof_backward(A.modality(spark, d, "gnss"), keys, "stamp_us", ["kf_id"], width=SWEEP_US).filter("kf_id is not null").select("event_id", "kf_id")


def point_id():
    """A point's number: its scan's, with room for 2**20 points."""
    return F.shiftleft(F.col("scan_id").cast("long"), 20) + F.col("idx")


def _queries_targets(spark, d):
    """All points, as queries and as targets; points of one scan aren't matched with one another."""
    p = A.point(spark, d)
    return p.select(point_id().alias("q"), "scan_id", "x", "y", "z"), p.select(point_id().alias("id"), "scan_id", "x", "y", "z")


GRID = """g AS (SELECT scan_id, (scan_id << 20) + idx AS id, x, y, z, floor(x / {0}) AS cx, floor(y / {0}) AS cy, floor(z / {0}) AS cz FROM v_point)"""
PAIRS = """p AS (SELECT a.scan_id, a.id AS q, b.id, pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2) AS d2, a.probe FROM (SELECT *, cx + i AS px, cy + j AS py, cz + k AS pz, (i + 1) * 9 + (j + 1) * 3 + k + 1 AS probe
    FROM g, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) a JOIN g b ON b.cx = a.px AND b.cy = a.py AND b.cz = a.pz AND a.scan_id <> b.scan_id)"""
NEAREST = "(SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, probe, id) AS n FROM p WHERE d2 <= {})"


@section.add("voxel_nn_join", with_views(f"SELECT q, id, round(d2, 6) AS d2 FROM {NEAREST.format(0.8 * 0.8)} WHERE n = 1", GRID.format(0.8), PAIRS))
def _(spark, d):
    return rounded(J.voxel_nn(_queries_targets(spark, d)[0], None, 0.8, 0.8, apart="scan_id"))


@section.add("voxel_radius_join", with_views("SELECT q, id, round(d2, 6) AS d2 FROM p WHERE d2 <= 0.81", GRID.format(0.9), PAIRS))
def _(spark, d):
    return rounded(J.voxel_radius(*_queries_targets(spark, d), 0.9, 0.9, apart="scan_id"))


@section.add(
    "plane_lookup_join",
    with_views(
        """SELECT q, plane, round(rms, 6) AS rms FROM (SELECT q.q, p.plane, p.rms, row_number() OVER (PARTITION BY q.q ORDER BY (p.cx = q.cx AND p.cy = q.cy AND p.cz = q.cz) DESC, p.rms, p.plane) AS n
        FROM q JOIN p ON abs(p.cx - q.cx) <= 1 AND abs(p.cy - q.cy) <= 1 AND abs(p.cz - q.cz) <= 1) WHERE n = 1""",
        "q AS (SELECT (scan_id << 20) + idx AS q, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz FROM v_point)",
        "p AS (SELECT CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz, min((scan_id << 20) + idx) AS plane, round(stddev_pop(z), 9) AS rms FROM v_point GROUP BY 1, 2, 3 HAVING min(t_offset) < 2)",
    ),
)
def _(spark, d):
    p = J.cells(A.point(spark, d).withColumn("n", point_id()), 5.0)
    planes = p.groupBy("cx", "cy", "cz").agg(F.min("n").alias("plane"), F.round(F.stddev_pop("z"), 9).alias("rms"), F.min("t_offset").alias("t")).filter("t < 2").drop("t")
    return rounded(J.plane_lookup(p.select(F.col("n").alias("q"), "cx", "cy", "cz"), planes))


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t, kf_id) AS n FROM v_track)"


def _numbered(spark, d):
    return A.track(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("t", "kf_id")).cast("long"))


@section.add("revisit_candidates", with_views("SELECT a.run, a.n AS q, b.n AS id FROM n a JOIN n b ON a.run = b.run AND b.n < a.n AND a.n - b.n >= 2 AND a.t - b.t >= 86400000000 AND pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 6400", NUMBERED))
def _(spark, d):
    return J.revisit_candidates(_numbered(spark, d), 2, 86_400_000_000, 80.0, ["run"])


@section.add("colocated_pairs", with_views("SELECT a.run, b.n AS from_n, a.n AS to_n FROM n a JOIN n b ON a.run = b.run AND b.n < a.n AND a.n - b.n >= 1 AND a.t - b.t >= 0 AND pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 10000", NUMBERED))
def _(spark, d):
    return J.revisit_candidates(_numbered(spark, d), 1, 0, 100.0, ["run"]).select("run", F.col("id").alias("from_n"), F.col("q").alias("to_n"))


@section.add("outlier_pairs", with_views("SELECT run, from_n, to_n, gap FROM (SELECT a.run, b.n AS from_n, a.n AS to_n, a.n - b.n AS gap, row_number() OVER (PARTITION BY a.run ORDER BY a.n - b.n DESC, a.n) AS r FROM n a JOIN n b ON a.run = b.run AND a.n - b.n >= greatest(2, (SELECT max(n) FROM n c WHERE c.run = a.run) // 3)) WHERE r <= 3", NUMBERED))
def _(spark, d):
    n = _numbered(spark, d).select("run", "n").withColumn("m", F.max("n").over(Window.partitionBy("run")))
    # the three largest gaps of a run lie between its first and last three poses
    last, first = n.filter("n >= m - 2").select("run", F.col("n").alias("to_n"), "m"), n.filter("n <= 3").select("run", F.col("n").alias("from_n"))
    pairs = last.join(first, "run").filter(F.col("to_n") - F.col("from_n") >= F.greatest(F.lit(2), F.floor(F.col("m") / 3)))
    rank = Window.partitionBy("run").orderBy((F.col("to_n") - F.col("from_n")).desc(), "to_n")
    return pairs.withColumn("r", F.row_number().over(rank)).filter("r <= 3").select("run", "from_n", "to_n", (F.col("to_n") - F.col("from_n")).alias("gap"))


RING = "r AS (SELECT id, list_transform(range(8), lambda i: list_sum(d[i*8+1:i*8+8]) / 8) AS ring FROM v_descriptor)"


@section.add(
    "ring_key_knn",
    with_views("SELECT q, id, rank FROM (SELECT a.id AS q, b.id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(list_sum(list_transform(range(1, 9), lambda i: pow(a.ring[i] - b.ring[i], 2))), 9), b.id) AS INT) AS rank FROM r a JOIN r b ON b.id < a.id AND a.id % 20 = 0) WHERE rank <= 5", RING),
)
def _(spark, d):
    from posegrid.operators import place

    r = place.ring_keys(A.descriptor(spark, d), 8, 8).select("id", "ring")
    return place.ring_key_knn(r.filter("id % 20 = 0"), r, 5).select("q", "id", "rank")


@section.add("region_join", with_views("SELECT g AS region, run AS id FROM (SELECT run, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM v_track GROUP BY run), (SELECT unnest([0, 1]) AS g) WHERE CASE g WHEN 0 THEN ax <= 50 AND bx >= 0 AND ay <= 100 AND by_ >= 0 ELSE ax <= 400 AND bx >= 300 AND ay <= 900 AND by_ >= 800 END"))
def _(spark, d):
    boxes = A.track(spark, d).groupBy(F.col("run").alias("id")).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    regions = spark.createDataFrame([(0, 0.0, 50.0, 0.0, 100.0), (1, 300.0, 400.0, 800.0, 900.0)], "region int, r_min_x double, r_max_x double, r_min_y double, r_max_y double")
    return J.region_join(boxes, regions)


@section.add("radius_join", with_views("SELECT kf_id FROM v_track WHERE pow(x - 150, 2) + pow(y - 500, 2) <= 10000"))
def _(spark, d):
    return J.radius_join(A.track(spark, d), (150.0, 500.0), 100.0).select("kf_id")


@section.add("extrinsic_lookup", with_views("SELECT event_id, CASE sensor_id WHEN 1 THEN 0.5 WHEN 3 THEN -0.25 ELSE 0.0 END AS tx FROM v_sensor"))
def _(spark, d):
    e = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (3, -0.25, 0.0, 1.0)], "sensor_id int, tx double, ty double, tz double")
    return J.extrinsic_lookup(A.sensor(spark, d), e, True).select("event_id", "tx")


@section.add("not_yet_mapped", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    o = A.table(spark, d, "orders")
    placed = o.join(A.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    mapped = A.table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    ids = lambda x: x.select(F.col("o_orderkey").alias("id"))
    return J.not_yet_mapped(ids(o), mapped, ids(placed))


@section.add(
    "identity_check_join",
    with_views("SELECT coalesce(a.run, b.run) AS run, count(*) AS n, count(*) FILTER (a.rank IS NULL OR b.rank IS NULL) AS unmatched, round(max(abs(a.x - b.x)), 6) AS worst FROM a FULL JOIN b ON a.run = b.run AND a.rank = b.rank GROUP BY 1",
        "a AS (SELECT run, x, row_number() OVER (PARTITION BY run ORDER BY t, kf_id) AS rank FROM v_track)", "b AS (SELECT run, x, row_number() OVER (PARTITION BY run ORDER BY t, kf_id) AS rank FROM v_track WHERE kf_id % 10 <> 0)"),
)
def _(spark, d):
    t = A.track(spark, d)
    z = J.positional_zip(t, t.filter("kf_id % 10 <> 0"), ["run"], ["t", "kf_id"])
    missing = F.count(F.when(F.col("a_x").isNull() | F.col("b_x").isNull(), 1))
    return rounded(z.groupBy("run").agg(F.count(F.lit(1)).alias("n"), missing.alias("unmatched"), F.max(F.abs(F.col("a_x") - F.col("b_x"))).alias("worst")))


@section.add("inject_loops_join", "SELECT o_orderkey AS kf_id, l_linenumber, l_partkey AS from_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45")
def _(spark, d):
    loops = A.table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("kf_id"), "l_linenumber", F.col("l_partkey").alias("from_id"))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("kf_id")).join(loops, "kf_id").select("kf_id", "l_linenumber", "from_id")


VOXELS = "v AS (SELECT CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz, count(*) AS value FROM v_point GROUP BY 1, 2, 3 HAVING count(*) % 7 > 0)"


def voxels(spark, d):
    p = A.point(spark, d)
    return p.groupBy(F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy"), F.floor(F.col("z") / 5).alias("cz")).agg(F.count(F.lit(1)).alias("value")).filter("value % 7 > 0")


@section.add("cube_corner_join", with_views("SELECT a.cx, a.cy, a.cz, CAST(sum(b.value) AS BIGINT) AS total FROM v a JOIN v b ON b.cx - a.cx IN (0, 1) AND b.cy - a.cy IN (0, 1) AND b.cz - a.cz IN (0, 1) GROUP BY 1, 2, 3 HAVING count(*) = 8", VOXELS))
def _(spark, d):
    c = J.cube_corners(voxels(spark, d))
    return c.select("cx", "cy", "cz", F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@section.add(
    "occlusion_march",
    with_views("SELECT DISTINCT ray FROM (SELECT (scan_id << 20) + idx AS ray, x, y, z, sqrt(x*x+y*y+z*z) AS len, unnest(range(0, CAST(floor((sqrt(x*x+y*y+z*z) - 12.5) / 2.5) AS BIGINT) + 1)) AS s FROM v_point WHERE sqrt(x*x+y*y+z*z) >= 12.5) JOIN o ON o.cx = floor(x / len * (5 + s * 2.5) / 5) AND o.cy = floor(y / len * (5 + s * 2.5) / 5) AND o.cz = floor(z / len * (5 + s * 2.5) / 5)",
        "o AS (SELECT floor(x / 5) AS cx, floor(y / 5) AS cy, floor(z / 5) AS cz FROM v_point GROUP BY 1, 2, 3 HAVING round(avg(z - 5 * floor(z / 5)), 9) < 1.9)"),
)
def _(spark, d):
    p = A.point(spark, d).withColumn("len", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    rays = p.select(point_id().alias("ray"), "len", *[F.lit(0.0).alias(f"o{a}") for a in "xyz"], *[(F.col(a) / F.col("len")).alias(f"d{a}") for a in "xyz"])
    # voxels that are filled low count as solid
    low = F.round(F.avg(F.col("z") - 5 * F.col("cz")), 9)
    solid = J.cells(p, 5.0).groupBy("cx", "cy", "cz").agg(low.alias("low")).filter("low < 1.9").select("cx", "cy", "cz")
    return J.occlusion_march(rays, solid, 5.0)


@section.add(
    "moved_window_semi_join",
    with_views("SELECT DISTINCT a.kf_id AS anchor FROM n a JOIN n b ON a.run = b.run AND b.n BETWEEN a.n - 2 AND a.n WHERE b.x > 300", NUMBERED),
)
def _(spark, d):
    t = A.track(spark, d)
    window = Window.partitionBy("run").orderBy("t", "kf_id").rowsBetween(-2, 0)
    return J.moved_windows(t.withColumn("ids", F.collect_list("kf_id").over(window)).select(F.col("kf_id").alias("anchor"), "ids"), t.filter("x > 300").select(F.col("kf_id").alias("id")))


@section.add("gicp_correspondence", with_views(f"SELECT q, id, round(d2, 6) AS d2 FROM {NEAREST.format(1.0)} WHERE n = 1", GRID.format(1.0), PAIRS))
def _(spark, d):
    return rounded(J.voxel_nn(_queries_targets(spark, d)[0], None, 1.0, 1.0, apart="scan_id"))
