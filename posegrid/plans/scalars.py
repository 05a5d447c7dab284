"""Queries of scalar functions: geodesy, rigid motions, camera, colour, grids, keys."""

from __future__ import annotations

import math

import numpy as np
from posegrid import adapters as A
from posegrid.adapters import with_views
from posegrid.functions import geometry as M
from posegrid.functions import manifold
from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Section, rounded

section = Section()
col = F.col
N = "6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(lat)), 2))"
ECEF = f"e AS (SELECT id, ({N} + alt) * cos(radians(lat)) * cos(radians(lon)) AS ex, ({N} + alt) * cos(radians(lat)) * sin(radians(lon)) AS ey, ({N} * (1 - 0.0066943799901413165) + alt) * sin(radians(lat)) AS ez FROM v_geo)"


@section.add("wgs84_to_ecef", with_views("SELECT id, round(ex, 4) AS ex, round(ey, 4) AS ey, round(ez, 4) AS ez FROM e", ECEF))
def _(spark, d):
    x, y, z = M.wgs84_to_ecef(col("lat"), col("lon"), col("alt"))
    return rounded(A.geo(spark, d).select("id", x.alias("ex"), y.alias("ey"), z.alias("ez")), 4)


X0, Y0, Z0 = M._ecef(48.0, 2.0, 0.0)
ENU = f"""SELECT id, round(-sin(radians(2))*dx + cos(radians(2))*dy, 3) + 0.0 AS east, round(-sin(radians(48))*cos(radians(2))*dx - sin(radians(48))*sin(radians(2))*dy + cos(radians(48))*dz, 3) + 0.0 AS north,
    round(cos(radians(48))*cos(radians(2))*dx + cos(radians(48))*sin(radians(2))*dy + sin(radians(48))*dz, 3) + 0.0 AS up FROM (SELECT id, ex - {X0!r} AS dx, ey - {Y0!r} AS dy, ez - {Z0!r} AS dz FROM e)"""


@section.add("ecef_to_enu", with_views(ENU, ECEF))
def _(spark, d):
    e, n, u = M.ecef_to_enu(*M.wgs84_to_ecef(col("lat"), col("lon"), col("alt")), 48.0, 2.0, 0.0)
    return rounded(A.geo(spark, d).select("id", e.alias("east"), n.alias("north"), u.alias("up")), 3)


@section.add("lla_to_enu", with_views(ENU, ECEF))
def _(spark, d):
    e, n, u = M.lla_to_enu(col("lat"), col("lon"), col("alt"), 48.0, 2.0, 0.0)
    return rounded(A.geo(spark, d).select("id", e.alias("east"), n.alias("north"), u.alias("up")), 3)


# Poses turned about z: the quaternion algebra must agree with plane rotations written out.
YAW = "radians(kf_id % 360)"


def posed(spark, d):
    yaw = F.radians((col("kf_id") % 360).cast("double"))
    q = {"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(yaw / 2), "qw": F.cos(yaw / 2)}
    return A.track(spark, d).withColumns(q).withColumn("z", col("x") / 10)




def pose():
    """Quaternion and translation columns of a posed row."""
    return tuple(map(col, ("qx", "qy", "qz", "qw"))), tuple(map(col, ("x", "y", "z")))


@section.add("transform_points", with_views(f"SELECT kf_id, round(cos({YAW})*3 - sin({YAW})*4 + x, 6) AS a, round(sin({YAW})*3 + cos({YAW})*4 + y, 6) AS b, round(5 + x / 10, 6) AS c FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    a, b, c = M.se3_apply(q0, t0, (F.lit(3.0), F.lit(4.0), F.lit(5.0)))
    return rounded(posed(spark, d).select("kf_id", a.alias("a"), b.alias("b"), c.alias("c")))


section.queries["se3_apply"], section.sql["se3_apply"] = section.queries["transform_points"], section.sql["transform_points"]


@section.add("rotate_imu_to_body", with_views("SELECT event_id, round(CASE WHEN sensor_id % 2 = 1 THEN -k ELSE value END, 6) + 0.0 AS ax, round(CASE WHEN sensor_id % 2 = 1 THEN value ELSE k END, 6) + 0.0 AS ay FROM v_sensor WHERE modality = 'imu'"))
def _(spark, d):
    h = 0.5**0.5
    dim = spark.createDataFrame([(i, h if i % 2 else 0.0, h if i % 2 else 1.0) for i in range(8)], "sensor_id int, qz double, qw double")
    v = M.rotate((F.lit(0.0), F.lit(0.0), col("qz"), col("qw")), (col("value"), col("k").cast("double"), F.lit(0.0)))
    return rounded(A.modality(spark, d, "imu").join(F.broadcast(dim), "sensor_id").select("event_id", v[0].alias("ax"), v[1].alias("ay")))


@section.add("se3_compose", with_views(f"SELECT kf_id, round(cos({YAW}/2 + 0.25), 6) + 0.0 AS qw, round(cos({YAW})*1 - sin({YAW})*2 + x, 6) + 0.0 AS tx FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    q, t = M.se3_compose(q0, t0, (F.lit(0.0), F.lit(0.0), F.sin(F.lit(0.25)), F.cos(F.lit(0.25))), (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rounded(posed(spark, d).select("kf_id", q[3].alias("qw"), t[0].alias("tx")))


@section.add("se3_inverse", with_views(f"SELECT kf_id, round(-(cos({YAW})*x + sin({YAW})*y), 6) + 0.0 AS tx, round(-(-sin({YAW})*x + cos({YAW})*y), 6) + 0.0 AS ty FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    _, t = M.se3_inverse(q0, t0)
    return rounded(posed(spark, d).select("kf_id", t[0].alias("tx"), t[1].alias("ty")))


@section.add("relative_pose", with_views(f"SELECT kf_id, round(cos({YAW})*(7-x) + sin({YAW})*(9-y), 6) + 0.0 AS tx, round(-sin({YAW})*(7-x) + cos({YAW})*(9-y), 6) + 0.0 AS ty FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    _, t = M.relative_pose(q0, t0, (F.lit(0.0),) * 3 + (F.lit(1.0),), (F.lit(7.0), F.lit(9.0), F.lit(0.0)))
    return rounded(posed(spark, d).select("kf_id", t[0].alias("tx"), t[1].alias("ty")))


@section.add("quat_to_mat", with_views(f"SELECT kf_id, round(cos({YAW}), 6) + 0.0 AS m00, round(-sin({YAW}), 6) + 0.0 AS m01, round(sin({YAW}), 6) + 0.0 AS m10 FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    m = M.quat_to_mat(q0)
    return rounded(posed(spark, d).select("kf_id", m[0].alias("m00"), m[1].alias("m01"), m[3].alias("m10")))


#: Turns about all axes, through all branches: which entry is largest changes with the id.
TURNS = "q AS (SELECT kf_id, a / n AS a, b / n AS b, c / n AS c, w / n AS w FROM (SELECT *, sqrt(a*a + b*b + c*c + w*w) AS n FROM (SELECT kf_id, (kf_id % 7 - 3) / 3 AS a, (kf_id % 5 - 2) / 2 AS b, (kf_id % 11 - 5) / 4 AS c, 0.05 + (kf_id % 3) / 2 AS w FROM v_track)))"


def turns():
    k = col("kf_id")
    return M.quat_normalise(((k % 7 - 3) / 3, (k % 5 - 2) / 2, (k % 11 - 5) / 4, 0.05 + (k % 3) / 2))


@section.add("mat_to_quat", with_views("SELECT kf_id, round(a, 6) + 0.0 AS qx, round(b, 6) + 0.0 AS qy, round(c, 6) + 0.0 AS qz, round(w, 6) + 0.0 AS qw FROM q", TURNS))
def _(spark, d):
    """Quaternions of rotation matrices; either sign is the same turn, so the last entry is made positive."""
    q = M.mat_to_quat(M.quat_to_mat(turns()))
    t = A.track(spark, d).select("kf_id", F.struct(*[v.alias(n) for v, n in zip(q, "abcw", strict=True)]).alias("q"))
    sign = F.when(col("q.w") < 0, -1.0).otherwise(1.0)
    return rounded(t.select("kf_id", *[(col(f"q.{n}") * sign).alias(f"q{m}") for n, m in zip("abcw", "xyzw", strict=True)]))


@section.add("quat_slerp", with_views(f"SELECT kf_id, round(abs(cos(d / 2 * 0.25)), 5) AS qw FROM (SELECT kf_id, CASE WHEN {YAW} > pi() THEN 2 * pi() - {YAW} ELSE {YAW} END AS d FROM v_track)"))
def _(spark, d):
    q0, t0 = pose()
    q = M.quat_slerp((F.lit(0.0),) * 3 + (F.lit(1.0),), q0, F.lit(0.25))
    return rounded(posed(spark, d).select("kf_id", F.abs(q[3]).alias("qw")), 5)


@section.add("quat_angle", with_views(f"SELECT kf_id, round(CASE WHEN {YAW} > pi() THEN 2 * pi() - {YAW} ELSE {YAW} END, 6) AS angle FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    return rounded(posed(spark, d).select("kf_id", M.quat_angle((F.lit(0.0),) * 3 + (F.lit(1.0),), q0).alias("angle")))


@section.add("so3_exp", with_views("SELECT kf_id, round(sin(sqrt(3)*x/200) * 0.5773502691896258, 6) + 0.0 AS qx, round(cos(sqrt(3)*x/200), 6) + 0.0 AS qw FROM v_track"))
def _(spark, d):
    q = M.so3_exp((col("x") / 100,) * 3)
    return rounded(A.track(spark, d).select("kf_id", q[0].alias("qx"), q[3].alias("qw")))


#: The exponential of (r, p) in closed form: q and t from columns r0..r2, p0..p2.
EXP = """th AS (SELECT *, sqrt(p0*p0 + p1*p1 + p2*p2) AS th, p1*r2 - p2*r1 AS w0, p2*r0 - p0*r2 AS w1, p0*r1 - p1*r0 AS w2 FROM xi),
    ex AS (SELECT *, p0*sin(th/2)/th AS ex, p1*sin(th/2)/th AS ey, p2*sin(th/2)/th AS ez, cos(th/2) AS ew, r0 + (1-cos(th))/(th*th)*w0 + (th-sin(th))/pow(th,3)*(p1*w2 - p2*w1) AS tx,
    r1 + (1-cos(th))/(th*th)*w1 + (th-sin(th))/pow(th,3)*(p2*w0 - p0*w2) AS ty, r2 + (1-cos(th))/(th*th)*w2 + (th-sin(th))/pow(th,3)*(p0*w1 - p1*w0) AS tz FROM th)"""
XI = "xi AS (SELECT kf_id, x/100 AS r0, y/1000 AS r1, 0.5::DOUBLE AS r2, 0.1::DOUBLE AS p0, y/1000 AS p1, -0.2::DOUBLE AS p2 FROM v_track)"


@section.add("se3_exp", with_views("SELECT kf_id, round(ex, 6) + 0.0 AS qx, round(ey, 6) + 0.0 AS qy, round(ez, 6) + 0.0 AS qz, round(ew, 6) + 0.0 AS qw, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, round(tz, 6) + 0.0 AS tz FROM ex", XI, EXP))
def _(spark, d):
    q, t = M.se3_exp((col("x") / 100, col("y") / 1000, F.lit(0.5)), (F.lit(0.1), col("y") / 1000, F.lit(-0.2)))
    return rounded(A.track(spark, d).select("kf_id", *[c.alias(n) for c, n in zip((*q, *t), ("qx", "qy", "qz", "qw", "tx", "ty", "tz"), strict=True)]))


#: The turn by its half angle, the translation by the inverse of the left Jacobian.
LOGS = """v AS (SELECT *, sqrt(a*a + b*b + c*c) AS s FROM q), f AS (SELECT kf_id, x / 300 * pi() AS x, y / 1000 AS y, 0.5 AS z, CASE WHEN s > 0 THEN 2 * atan2(s, w) / s ELSE 2 END * a AS p0, CASE WHEN s > 0 THEN 2 * atan2(s, w) / s ELSE 2 END * b AS p1, CASE WHEN s > 0 THEN 2 * atan2(s, w) / s ELSE 2 END * c AS p2 FROM v JOIN v_track USING (kf_id)),
    g AS (SELECT *, CASE WHEN th > 1e-4 THEN 1 / (th*th) - (1 + cos(th)) / (2 * th * sin(th)) ELSE 1.0 / 12 END AS k, p1*z - p2*y AS w0, p2*x - p0*z AS w1, p0*y - p1*x AS w2 FROM (SELECT *, sqrt(p0*p0 + p1*p1 + p2*p2) AS th FROM f))"""


@section.add("se3_log", with_views("SELECT kf_id, round(x - w0/2 + k*(p1*w2 - p2*w1), 6) + 0.0 AS r0, round(y - w1/2 + k*(p2*w0 - p0*w2), 6) + 0.0 AS r1, round(z - w2/2 + k*(p0*w1 - p1*w0), 6) + 0.0 AS r2, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2 FROM g", TURNS, LOGS))
def _(spark, d):
    """Logarithms of poses turned about all axes."""
    back = manifold.batched(manifold.log, manifold.TANGENT, *turns(), col("x") / 300 * math.pi, col("y") / 1000, F.lit(0.5))
    return rounded(A.track(spark, d).select("kf_id", back.alias("v")).select("kf_id", "v.*"))


STEP = (0.3, -0.1, 0.2, 0.05, -0.15, 0.25)


#: On the plane the difference of two poses has a closed form: half the turn, and half of it times its cotangent.
APART = """s AS (SELECT run, kf_id, x, y, radians(kf_id % 360) AS yaw, lead(kf_id) OVER w AS next, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(radians(kf_id % 360)) OVER w AS turn FROM v_track WINDOW w AS (PARTITION BY run ORDER BY t, kf_id)),
    h AS (SELECT *, (cos(yaw)*dx + sin(yaw)*dy) / 100 AS u, (cos(yaw)*dy - sin(yaw)*dx) / 100 AS v, atan2(sin(turn - yaw), cos(turn - yaw)) / 2 AS f FROM s WHERE next IS NOT NULL),
    e AS (SELECT *, CASE WHEN abs(f) > 1e-6 THEN f / tan(f) ELSE 1 END AS k FROM h)"""


@section.add("boxplus_boxminus", with_views("SELECT kf_id, round(k*u + f*v, 6) + 0.0 AS r0, round(k*v - f*u, 6) + 0.0 AS r1, round(2 * f, 6) + 0.0 AS p2, true AS back FROM e WHERE abs(abs(f) - pi() / 2) > 1e-6", APART))
def _(spark, d):
    """What leads from each keyframe to the next of its run, and whether adding it does; half turns, whose sign is open, left to the tests."""
    w = Window.partitionBy("run").orderBy("t", "kf_id")
    names = ("qx", "qy", "qz", "qw", "x", "y")
    p = posed(spark, d).withColumn("x", col("x") / 100).withColumn("y", col("y") / 100).withColumns({f"n_{c}": F.lead(c).over(w) for c in names}).filter("n_x is not null")
    zero = F.lit(0.0)

    def apart(v: np.ndarray) -> np.ndarray:
        step = manifold.boxminus(v[:, 7:], v[:, :7])
        miss = np.abs(manifold.boxminus(manifold.boxplus(v[:, :7], step), v[:, 7:])).max(axis=1)
        return np.concatenate([step, miss[:, None]], axis=1)

    both = manifold.batched(apart, (*manifold.TANGENT, "miss"), *[col(c) for c in names], zero, *[col(f"n_{c}") for c in names], zero)
    out = p.select("kf_id", both.alias("v")).filter(F.abs(F.abs("v.p2") / 2 - math.pi / 2) > 1e-6)
    return rounded(out.select("kf_id", "v.r0", "v.r1", "v.p2", (col("v.miss") < 1e-9).alias("back")))


HALF = "xi AS (SELECT 0.15::DOUBLE AS r0, -0.05::DOUBLE AS r1, 0.1::DOUBLE AS r2, 0.025::DOUBLE AS p0, -0.075::DOUBLE AS p1, 0.125::DOUBLE AS p2)"


@section.add("se3_interpolate", with_views("SELECT kf_id, round(c*ex - s*ey, 6) + 0.0 AS qx, round(c*ey + s*ex, 6) + 0.0 AS qy, round(c*ez + s*ew, 6) + 0.0 AS qz, round(c*ew - s*ez, 6) + 0.0 AS qw, round((c*c - s*s)*tx - 2*s*c*ty + x, 6) + 0.0 AS tx, round(2*s*c*tx + (c*c - s*s)*ty + y, 6) + 0.0 AS ty, round(tz + x / 10, 6) + 0.0 AS tz FROM (SELECT *, sin(radians(kf_id % 360) / 2) AS s, cos(radians(kf_id % 360) / 2) AS c FROM v_track), ex", HALF, EXP))
def _(spark, d):
    q0, t0 = pose()
    half = lambda v: manifold.interpolate(v, manifold.boxplus(v, np.tile(STEP, (len(v), 1))), np.full((len(v), 1), 0.5))
    return rounded(posed(spark, d).select("kf_id", manifold.batched(half, manifold.POSE, *q0, *t0).alias("v")).select("kf_id", "v.*"))


ADJOINT = {(0, 0): "c", (0, 1): "-s", (1, 0): "s", (1, 1): "c", (2, 2): "1.0"}
ADJOINT |= {(i + 3, j + 3): v for (i, j), v in ADJOINT.items()} | {(0, 3): "-z*s", (0, 4): "-z*c", (0, 5): "y", (1, 3): "z*c", (1, 4): "-z*s", (1, 5): "-x", (2, 3): "x*s - y*c", (2, 4): "y*s + x*c"}
ENTRIES = ", ".join(f"round({ADJOINT.get((i, j), '0.0')}, 6) + 0.0 AS a{i}{j}" for i in range(6) for j in range(6))


@section.add("adjoint6", with_views(f"SELECT kf_id, {ENTRIES} FROM (SELECT *, x / 10 AS z, sin(radians(kf_id % 360)) AS s, cos(radians(kf_id % 360)) AS c FROM v_track)"))
def _(spark, d):
    q0, t0 = pose()
    names = tuple(f"a{i}{j}" for i in range(6) for j in range(6))
    return rounded(posed(spark, d).select("kf_id", manifold.batched(lambda v: manifold.adjoint(v).reshape(-1, 36), names, *q0, *t0).alias("v")).select("kf_id", "v.*"))


CLAMPED = """m AS (SELECT kf_id, x / 300 * pi() - 2 AS a, y / 500 - 1 AS b, (kf_id % 7 - 3) / 2 AS c, kf_id % 5 - 2 AS e FROM v_track), l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b*b) AS hi, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b*b) AS lo FROM m),
    k AS (SELECT *, greatest(hi, 0.0) AS h, greatest(lo, 0.0) AS g, CASE WHEN hi > lo THEN (a - lo) / (hi - lo) ELSE 1 END AS p, CASE WHEN hi > lo THEN b / (hi - lo) ELSE 0 END AS q FROM l)"""


@section.add("psd_clamp", with_views("SELECT kf_id, round(g + (h - g) * p, 6) + 0.0 AS a, round((h - g) * q, 6) + 0.0 AS b, round(g + (h - g) * (1 - p), 6) + 0.0 AS c, round(greatest(e, 0), 6) + 0.0::DOUBLE AS e FROM k", CLAMPED))
def _(spark, d):
    """Symmetric matrices with two axes mixed: their negative eigenvalues become zero, the others stay, as do the directions."""

    def clamp(v: np.ndarray) -> np.ndarray:
        m = np.zeros((len(v), 3, 3))
        m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1], m[:, 2, 2] = v[:, 0], v[:, 1], v[:, 1], v[:, 2], v[:, 3]
        return manifold.psd_clamp(m)[:, [0, 0, 1, 2], [0, 1, 1, 2]]

    k = col("kf_id")
    parts = (col("x") / 300 * math.pi - 2, col("y") / 500 - 1, (k % 7 - 3) / 2, (k % 5 - 2).cast("double"))
    return rounded(A.track(spark, d).select("kf_id", manifold.batched(clamp, ("a", "b", "c", "e"), *parts).alias("v")).select("kf_id", "v.*"))


@section.add("reframe_gt", with_views(f"SELECT kf_id, round(cos({YAW})*0.25 - sin({YAW})*-0.5 + x, 6) + 0.0 AS tx, round(sin({YAW})*0.25 + cos({YAW})*-0.5 + y, 6) + 0.0 AS ty FROM v_track"))
def _(spark, d):
    q0, t0 = pose()
    _, t = M.se3_compose(q0, t0, (F.lit(0.0),) * 3 + (F.lit(1.0),), (F.lit(0.25), F.lit(-0.5), F.lit(1.0)))
    return rounded(posed(spark, d).select("kf_id", t[0].alias("tx"), t[1].alias("ty")))


@section.add("deskew", with_views("SELECT scan_id, idx, round(cos(a)*x - sin(a)*y + 2*sin(a)/0.1, 6) + 0.0 AS dx, round(sin(a)*x + cos(a)*y + 2*(1-cos(a))/0.1, 6) + 0.0 AS dy FROM (SELECT *, 0.1 * (t_offset - 7) / 10 AS a FROM v_point)"))
def _(spark, d):
    p = M.deskew((F.lit(2.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(0.1)), (col("t_offset") - 7) / 10, (col("x"), col("y"), col("z")))
    return rounded(A.point(spark, d).select("scan_id", "idx", p[0].alias("dx"), p[1].alias("dy")))


@section.add("huber_weight", with_views("SELECT event_id, round(CASE WHEN abs(value / 20) <= 1.345 THEN 1.0 ELSE 1.345 / abs(value / 20) END, 6) AS w FROM v_sensor"))
def _(spark, d):
    return rounded(A.sensor(spark, d).select("event_id", M.huber_weight(col("value") / 20).alias("w")))


#: Covariances whose inverse is written out: L L' with L lower triangular, so that the distance is that of forward substitution.
@section.add("mahalanobis", with_views("SELECT scan_id, idx, round((u*u + v*v + w*w) / pi(), 6) AS d2 FROM (SELECT *, (z - 0.5*u - s*v) / 0.5 AS w FROM (SELECT *, (y - s*u) / 3 AS v FROM (SELECT scan_id, idx, y, z, x / 2 AS u, (t_offset - 4) / 4 AS s FROM v_point)))"))
def _(spark, d):
    """Distances under full covariances, other ones for each place in a scan; over pi, so that no sum of decimals lies where rounding tips."""
    s = (col("t_offset") - 4) / 4
    cov = (F.lit(4.0), 2 * s, F.lit(1.0), s * s + 9, 0.5 * s + 3 * s, 0.25 + s * s + 0.25)
    return rounded(A.point(spark, d).select("scan_id", "idx", (M.mahalanobis((col("x"), col("y"), col("z")), cov) / math.pi).alias("d2")))


@section.add("observability_inflate", with_views("SELECT scan_id, idx, round(CASE WHEN z / 10 < 0.2 THEN 100.0 ELSE 1 + 99 * pow(1 - z / 10, 2) END, 5) AS f FROM (SELECT scan_id, idx, round(z, 6) AS z FROM v_point)"))
def _(spark, d):
    # settled before it is compared with the threshold, at which many rows lie
    return rounded(A.point(spark, d).select("scan_id", "idx", M.observability_inflate(F.round("z", 6) / 10, 100.0, 2.0, 0.2).alias("f")), 5)


@section.add("cov_reorder", "SELECT vec_id AS id, i, round(CAST(embedding[((i // 6 + 3) % 6) * 6 + (i % 6 + 3) % 6 + 1] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, (SELECT unnest(range(0, 36)) AS i)")
def _(spark, d):
    from posegrid.operators.graph import cov_reorder

    return rounded(A.descriptor(spark, d).select("id", F.posexplode(cov_reorder(col("d"))).alias("i", "v")))


# --- camera and colour


PIXEL = """c AS (SELECT *, xn*xn + yn*yn AS r2 FROM (SELECT *, x/100/CASE WHEN z > 0 THEN z END AS xn, y/100/CASE WHEN z > 0 THEN z END AS yn FROM v_point)),
    u AS (SELECT *, 400 * (xn*(1+0.01*r2-0.002*r2*r2) + 2*0.001*xn*yn + 0.0005*(r2+2*xn*xn)) + 320 AS u, 410 * (yn*(1+0.01*r2-0.002*r2*r2) + 0.001*(r2+2*yn*yn) + 2*0.0005*xn*yn) + 240 AS v, 2 * (0.01 - 0.004*r2) AS slope, 1+0.01*r2-0.002*r2*r2 AS radial FROM c),
    j AS (SELECT *, radial + slope*xn*xn + 0.002*yn + 0.003*xn AS ux, slope*xn*yn + 0.002*xn + 0.001*yn AS uy, radial + slope*yn*yn + 0.006*yn + 0.001*xn AS vy FROM u)"""


@section.add("project", with_views("SELECT scan_id, idx, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, coalesce(u >= 0 AND u < 640 AND v >= 0 AND v < 480, false) AS inside, " + ", ".join(f"round({e}, 4) + 0.0 AS j{i}" for i, e in enumerate(("400*ux/z", "400*uy/z", "-400*(ux*xn + uy*yn)/z", "410*uy/z", "410*vy/z", "-410*(uy*xn + vy*yn)/z"))) + " FROM (SELECT * EXCLUDE z, CASE WHEN z > 0 THEN z END AS z FROM j)", PIXEL))
def _(spark, d):
    """Pixels of all points, whether they lie in the image, and how they move with the point."""
    names = ("u", "v", *(f"j{i}" for i in range(6)))
    seen = manifold.batched(lambda p: M.project_many(p, 400.0, 410.0, 320.0, 240.0, 0.01, -0.002, 0.001, 0.0005), names, col("x") / 100, col("y") / 100, col("z"))
    p = A.point(spark, d).select("scan_id", "idx", seen.alias("p")).select("scan_id", "idx", "p.*")
    return rounded(p.select("scan_id", "idx", "u", "v", M.in_image(col("u"), col("v"), 640, 480).alias("inside"), *names[2:]), 4)


@section.add("unproject", with_views("SELECT scan_id, idx, round(x / 100 + 1e-8, 5) AS ux, round(y / 100 + 1e-8, 5) AS uy FROM v_point"))
def _(spark, d):
    x, y = M.distort_radtan(col("x") / 100, col("y") / 100, 0.05, -0.01, 0.001, 0.0005)
    ux, uy = M.unproject(400 * x + 320, 410 * y + 240, 400.0, 410.0, 320.0, 240.0, 0.05, -0.01, 0.001, 0.0005, 40)
    return rounded(A.point(spark, d).select("scan_id", "idx", (ux + 1e-8).alias("ux"), (uy + 1e-8).alias("uy")), 5)


@section.add("distort", with_views("SELECT scan_id, idx, round(x/50*s, 6) AS dx, round(y/50*s, 6) AS dy FROM (SELECT *, t*(1+0.02*t*t-0.001*pow(t,4))/r AS s FROM (SELECT *, sqrt(pow(x/50,2)+pow(y/50,2)) AS r, atan(sqrt(pow(x/50,2)+pow(y/50,2))) AS t FROM v_point))"))
def _(spark, d):
    x, y = M.distort_equidistant(col("x") / 50, col("y") / 50, 0.02, -0.001)
    return rounded(A.point(spark, d).select("scan_id", "idx", x.alias("dx"), y.alias("dy")))


@section.add("srgb_to_linear", with_views("SELECT event_id, round(CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END, 6) AS v FROM (SELECT event_id, k / 100 AS c FROM v_sensor)"))
def _(spark, d):
    return rounded(A.sensor(spark, d).select("event_id", M.srgb_to_linear(col("k") / 100).alias("v")))


@section.add("linear_to_srgb", with_views("SELECT event_id, round(CASE WHEN c <= 0.0031308 THEN c * 12.92 ELSE 1.055 * pow(c, 1 / 2.4) - 0.055 END, 6) AS v FROM (SELECT event_id, k / 100 AS c FROM v_sensor)"))
def _(spark, d):
    return rounded(A.sensor(spark, d).select("event_id", M.linear_to_srgb(col("k") / 100).alias("v")))


POLY = ["greatest(0, least(1, " + " + ".join(f"({k!r}) * pow(c, {i})" for i, k in enumerate(ch)) + "))" for ch in M.TURBO]


@section.add("turbo", with_views(f"SELECT event_id, round({POLY[0]}, 6) AS r, round({POLY[1]}, 6) AS g, round({POLY[2]}, 6) AS b FROM (SELECT event_id, k / 100 AS c FROM v_sensor)"))
def _(spark, d):
    r, g, b = M.turbo(col("k") / 100)
    return rounded(A.sensor(spark, d).select("event_id", r.alias("r"), g.alias("g"), b.alias("b")))


@section.add("photometric", with_views("SELECT event_id, round(value * 0.01 / ((1 + k) / 1000 * 2), 6) AS v FROM v_sensor"))
def _(spark, d):
    return rounded(A.sensor(spark, d).select("event_id", M.photometric(col("value"), (1 + col("k")) / 1000, F.lit(2.0), 0.01).alias("v")))


# --- grids, arrays, keys


@section.add("voxel_key", with_views("SELECT scan_id, idx, CAST(floor((x - 25) / 3) AS BIGINT) AS cx, CAST(floor((y - 25) / 3) AS BIGINT) AS cy FROM v_point"))
def _(spark, d):
    cx, cy = M.voxel_key(col("x") - 25, col("y") - 25, edge=3.0)
    return A.point(spark, d).select("scan_id", "idx", cx.alias("cx"), cy.alias("cy"))


@section.add("azimuth_deg", with_views("SELECT scan_id, idx, round(CASE WHEN degrees(atan2(y - 25, x - 25)) < 0 THEN degrees(atan2(y - 25, x - 25)) + 360 ELSE degrees(atan2(y - 25, x - 25)) END, 6) AS az FROM v_point"))
def _(spark, d):
    return rounded(A.point(spark, d).select("scan_id", "idx", M.azimuth_deg(col("x") - 25, col("y") - 25).alias("az")))


@section.add("circshift", with_views("SELECT id, i, round(d[(i + 61) % 64 + 1], 6) + 0.0 AS v FROM v_descriptor, (SELECT unnest(range(0, 64)) AS i)"))
def _(spark, d):
    return rounded(A.descriptor(spark, d).select("id", F.posexplode(M.circshift(col("d"), 3)).alias("i", "v")))


COS = "list_aggregate(list_transform(range(0, 8), lambda j: 1 - list_sum(list_transform(range(0, 8), lambda i: a[i*8+j+1]*b[i*8+j+1])) / (sqrt(list_sum(list_transform(range(0, 8), lambda i: a[i*8+j+1]*a[i*8+j+1]))) * sqrt(list_sum(list_transform(range(0, 8), lambda i: b[i*8+j+1]*b[i*8+j+1]))))), 'avg')"


def neighbours(spark, d, step: int = 1):
    e = A.descriptor(spark, d)
    return e.select(col("id").alias("q"), col("d").alias("a")).join(e.select((col("id") + step).alias("q"), col("id"), col("d").alias("b")), "q")


@section.add("column_cosine_distance", with_views(f"SELECT q, round({COS}, 6) + 0.0 AS distance FROM (SELECT l.id AS q, l.d AS a, r.d AS b FROM v_descriptor l JOIN v_descriptor r ON r.id + 1 = l.id)"))
def _(spark, d):
    from posegrid.operators import place

    return rounded(neighbours(spark, d).select("q", place.column_cosine_distance(col("a"), col("b"), 8, 8).alias("distance")))


@section.add("time_conversions", with_views("SELECT event_id, stamp_us * 1000 AS ns, stamp_us // 1000000 AS s, (stamp_us % 1000000) * 1000 AS rest FROM v_sensor"))
def _(spark, d):
    s = F.floor(col("stamp_us") / 1_000_000)
    return A.sensor(spark, d).select("event_id", (col("stamp_us") * 1000).alias("ns"), s.alias("s"), ((col("stamp_us") - s * 1_000_000) * 1000).alias("rest"))


@section.add("health_bits", with_views("SELECT event_id, 1 << (k % 12) AS bit FROM v_sensor"))
def _(spark, d):
    return A.sensor(spark, d).select("event_id", M.health_bit(col("k") % 12).alias("bit"))


# fixed values: fix types, worst first
FIXES = ("none", "spp", "dgps", "rtk_float", "rtk_fixed")


@section.add("fix_rank", with_views("SELECT id, list_position(['none', 'spp', 'dgps', 'rtk_float', 'rtk_fixed'], CASE fix_rank WHEN 0 THEN 'none' WHEN 1 THEN 'spp' WHEN 2 THEN 'dgps' WHEN 3 THEN 'rtk_float' ELSE 'rtk_fixed' END) - 1 AS rank FROM v_geo"))
def _(spark, d):
    names = F.element_at(F.array(*map(F.lit, FIXES)), col("fix_rank") + 1)
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(FIXES) for x in (n, i)])[col("name")]
    return A.geo(spark, d).withColumn("name", names).select("id", rank.alias("rank"))


@section.add("key_units", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'm' WHEN event_type LIKE 'p%' THEN 's' WHEN event_type LIKE 's%' THEN 'rad' ELSE '' END AS unit, translate(event_type, 'aeiou', '_____') AS topic FROM events")
def _(spark, d):
    key = col("event_type")
    unit = F.when(key == "view", "m").when(key.startswith("p"), "s").when(key.startswith("s"), "rad").otherwise("")
    return A.table(spark, d, "events").select("event_id", unit.alias("unit"), F.translate(key, "aeiou", "_____").alias("topic"))


@section.add("regex_parsing", r"SELECT event_id, CAST(regexp_extract(props, '\"k\":\s*(\d+)', 1) AS BIGINT) AS k, len(regexp_extract_all(props, '\d')) AS digits FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long").alias("k"), F.size(F.regexp_extract_all("props", F.lit(r"\d"), F.lit(0))).alias("digits"))


@section.add("array_ops", with_views("SELECT id, list_position(d, list_min(d)) - 1 AS argmin, round(list_sum(list_transform(range(1, 64), lambda i: abs(d[i+1] - d[i]))), 6) AS travel FROM v_descriptor"))
def _(spark, d):
    steps = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.abs(F.element_at("d", i + 1) - F.element_at("d", i)))
    return rounded(A.descriptor(spark, d).select("id", (F.array_position("d", F.array_min("d")) - 1).alias("argmin"), F.aggregate(steps, F.lit(0.0), lambda s, x: s + x).alias("travel")))
