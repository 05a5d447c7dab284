"""Geodesy, rigid motions, colour, camera and grid functions as Column expressions (whole-stage codegen); only pixels of many terms and the inverse of the distortion go in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def wgs84_to_ecef(lat: Column, lon: Column, alt: Column) -> Vec:
    """Degrees and metres to earth-centred coordinates."""
    p, q = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - WGS84_E2) + alt) * F.sin(p)


def _ecef(lat: float, lon: float, alt: float) -> tuple[float, float, float]:
    p, q = math.radians(lat), math.radians(lon)
    n = WGS84_A / math.sqrt(1 - WGS84_E2 * math.sin(p) ** 2)
    return (n + alt) * math.cos(p) * math.cos(q), (n + alt) * math.cos(p) * math.sin(q), (n * (1 - WGS84_E2) + alt) * math.sin(p)


def ecef_to_enu(x: Column, y: Column, z: Column, lat0: float, lon0: float, alt0: float) -> Vec:
    """East, north and up at a datum."""
    x0, y0, z0 = _ecef(lat0, lon0, alt0)
    sp, cp, sl, cl = math.sin(math.radians(lat0)), math.cos(math.radians(lat0)), math.sin(math.radians(lon0)), math.cos(math.radians(lon0))
    dx, dy, dz = x - x0, y - y0, z - z0
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def lla_to_enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> Vec:
    return ecef_to_enu(*wgs84_to_ecef(lat, lon, alt), lat0, lon0, alt0)


def quat_mul(a: Quat, b: Quat) -> Quat:
    """Product of quaternions in x, y, z, w order."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def quat_conj(q: Quat) -> Quat:
    return -q[0], -q[1], -q[2], q[3]


def quat_normalise(q: Quat) -> Quat:
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(c / n for c in q)


def rotate(q: Quat, v: Vec) -> Vec:
    """v + 2w(u x v) + 2u x (u x v)."""
    x, y, z, w = q
    cx, cy, cz = y * v[2] - z * v[1], z * v[0] - x * v[2], x * v[1] - y * v[0]
    return v[0] + 2 * (w * cx + y * cz - z * cy), v[1] + 2 * (w * cy + z * cx - x * cz), v[2] + 2 * (w * cz + x * cy - y * cx)


def se3_apply(q: Quat, t: Vec, v: Vec) -> Vec:
    r = rotate(q, v)
    return r[0] + t[0], r[1] + t[1], r[2] + t[2]


def se3_compose(qa: Quat, ta: Vec, qb: Quat, tb: Vec) -> tuple[Quat, Vec]:
    return quat_mul(qa, qb), se3_apply(qa, ta, tb)


def se3_inverse(q: Quat, t: Vec) -> tuple[Quat, Vec]:
    c = quat_conj(q)
    r = rotate(c, t)
    return c, (-r[0], -r[1], -r[2])


def relative_pose(qa: Quat, ta: Vec, qb: Quat, tb: Vec) -> tuple[Quat, Vec]:
    """Pose of b seen from a."""
    c = quat_conj(qa)
    return quat_mul(c, qb), rotate(c, (tb[0] - ta[0], tb[1] - ta[1], tb[2] - ta[2]))


def quat_to_mat(q: Quat) -> list[Column]:
    """Nine entries, row by row."""
    x, y, z, w = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def mat_to_quat(m: list[Column]) -> Quat:
    """The branch with the largest divisor, so that no small number is divided by."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    trace = m00 + m11 + m22
    s0, s1, s2, s3 = F.sqrt(trace + 1) * 2, F.sqrt(1 + m00 - m11 - m22) * 2, F.sqrt(1 + m11 - m00 - m22) * 2, F.sqrt(1 + m22 - m00 - m11) * 2
    first, second, third = trace > 0, (m00 > m11) & (m00 > m22), m11 > m22
    pick = lambda a, b, c, d: F.when(first, a).when(second, b).when(third, c).otherwise(d)
    return (
        pick((m21 - m12) / s0, s1 / 4, (m01 + m10) / s2, (m02 + m20) / s3),
        pick((m02 - m20) / s0, (m01 + m10) / s1, s2 / 4, (m12 + m21) / s3),
        pick((m10 - m01) / s0, (m02 + m20) / s1, (m12 + m21) / s2, s3 / 4),
        pick(s0 / 4, (m21 - m12) / s1, (m02 - m20) / s2, (m10 - m01) / s3),
    )


def quat_angle(a: Quat, b: Quat) -> Column:
    """Angle between two unit quaternions."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3])))


def quat_slerp(a: Quat, b: Quat, u: Column) -> Quat:
    """Along the nearer arc; linear where both are nearly the same."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    th = F.acos(d)
    near = d > 0.9995
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * th) / F.sin(th))
    wb = sign * F.when(near, u).otherwise(F.sin(u * th) / F.sin(th))
    return quat_normalise(tuple(wa * p + wb * q for p, q in zip(a, b, strict=True)))


def so3_exp(v: Vec) -> Quat:
    """Unit quaternion of a rotation vector."""
    th = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    k = F.when(th < 1e-12, F.lit(0.5)).otherwise(F.sin(th / 2) / th)
    return v[0] * k, v[1] * k, v[2] * k, F.cos(th / 2)


def so3_log(q: Quat) -> Vec:
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    k = F.when(n < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(n, q[3]) / n)
    return q[0] * k, q[1] * k, q[2] * k


def _left(v: Vec, u: Vec) -> Vec:
    """The left Jacobian of SO(3) at v, times u."""
    th2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    th = F.sqrt(th2)
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    w = cross(v, u)
    ww = cross(v, w)
    small = th < 1e-6
    a, b = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(th)) / th2), F.when(small, F.lit(1 / 6)).otherwise((th - F.sin(th)) / (th2 * th))
    return tuple(u[i] + a * w[i] + b * ww[i] for i in range(3))


def se3_exp(rho: Vec, phi: Vec) -> tuple[Quat, Vec]:
    """Translation comes first in the tangent."""
    return so3_exp(phi), _left(phi, rho)


def deskew(v: Vec, w: Vec, dt: Column, p: Vec) -> Vec:
    """Exp(dt [v; w]) p: a point moved to the end of the sweep at constant velocity."""
    return se3_apply(*se3_exp(tuple(c * dt for c in v), tuple(c * dt for c in w)), p)


def huber_weight(r: Column, k: float = 1.345) -> Column:
    return F.when(F.abs(r) <= k, F.lit(1.0)).otherwise(k / F.abs(r))


def observability_inflate(score: Column, rho: float, gamma: float, lock: float) -> Column:
    return F.when(score < lock, F.lit(float(rho))).otherwise(1 + (rho - 1) * F.pow(1 - score, F.lit(float(gamma))))


def mahalanobis3(r: Vec, variance: Vec) -> Column:
    return sum((a * a / s for a, s in zip(r, variance, strict=True)), F.lit(0.0))


def mahalanobis(r: Vec, s: tuple[Column, Column, Column, Column, Column, Column]) -> Column:
    """Squared distance under a symmetric covariance (xx, xy, xz, yy, yz, zz), by its adjugate; null if that isn't positive definite."""
    a, b, c, d, e, f = s
    minors = (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)
    det = a * minors[0] + b * minors[1] + c * minors[2]
    x, y, z = r
    top = minors[0] * x * x + minors[3] * y * y + minors[5] * z * z + 2 * (minors[1] * x * y + minors[2] * x * z + minors[4] * y * z)
    return F.when((a > 0) & (minors[5] > 0) & (det > 0), top / F.when(det > 0, det))


# --- camera and colour


def project(p: Vec, fx: float, fy: float, cx: float, cy: float, k1: float = 0.0, k2: float = 0.0, p1: float = 0.0, p2: float = 0.0) -> tuple[Column, Column]:
    """Pinhole with radial and tangential distortion; null behind the camera."""
    x, y = p[0] / p[2], p[1] / p[2]
    u, v = distort_radtan(x, y, k1, k2, p1, p2)
    front = p[2] > 0
    return F.when(front, fx * u + cx), F.when(front, fy * v + cy)


def project_jacobian(p: Vec, fx: float, fy: float, k1: float = 0.0, k2: float = 0.0, p1: float = 0.0, p2: float = 0.0) -> list[Column]:
    """How a pixel (u, v) of ``project`` moves with the point: six entries, row by row; null behind the camera."""
    z = p[2]
    return [F.when(z > 0, v) for v in _jacobian(p[0] / z, p[1] / z, z, fx, fy, k1, k2, p1, p2)]


def _jacobian(x, y, z, fx: float, fy: float, k1: float, k2: float, p1: float, p2: float) -> list:
    r2 = x * x + y * y
    radial, slope = 1 + k1 * r2 + k2 * r2 * r2, 2 * (k1 + 2 * k2 * r2)
    ux, uy = radial + slope * x * x + 2 * p1 * y + 6 * p2 * x, slope * x * y + 2 * p1 * x + 2 * p2 * y
    vx, vy = uy, radial + slope * y * y + 6 * p1 * y + 2 * p2 * x
    return [fx * ux / z, fx * uy / z, -fx * (ux * x + uy * y) / z, fy * vx / z, fy * vy / z, -fy * (vx * x + vy * y) / z]


def project_many(p: np.ndarray, fx: float, fy: float, cx: float, cy: float, k1: float = 0.0, k2: float = 0.0, p1: float = 0.0, p2: float = 0.0) -> np.ndarray:
    """(rows, 8): pixels of ``project`` and entries of ``project_jacobian`` for places (rows, 3), not a number behind the camera. Eight such expressions side by side are too long a method for the JVM to compile."""
    with np.errstate(all="ignore"):
        z = np.where(p[:, 2] > 0, p[:, 2], np.nan)
        x, y = p[:, 0] / z, p[:, 1] / z
        u, v = distort_radtan(x, y, k1, k2, p1, p2)
        return np.stack([fx * u + cx, fy * v + cy, *_jacobian(x, y, z, fx, fy, k1, k2, p1, p2)], axis=1)


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    """Whether a pixel lies in the image; false without one."""
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def distort_radtan(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float) -> tuple[Column, Column]:
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def distort_equidistant(x: Column, y: Column, k1: float, k2: float) -> tuple[Column, Column]:
    r = F.sqrt(x * x + y * y)
    th = F.atan(r)
    d = th * (1 + k1 * th * th + k2 * F.pow(th, F.lit(4.0)))
    s = F.when(r < 1e-12, F.lit(1.0)).otherwise(d / r)
    return x * s, y * s


def undistorted(x0: np.ndarray, y0: np.ndarray, k1: float, k2: float, p1: float, p2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point inverse of the distortion, ``steps`` of it; rows that a step leaves as they are have all of theirs."""
    x, y = x0.copy(), y0.copy()
    at = np.arange(len(x0))
    for _ in range(steps):
        u, v = x[at], y[at]
        dx, dy = distort_radtan(u, v, k1, k2, p1, p2)
        x[at], y[at] = u + x0[at] - dx, v + y0[at] - dy
        at = at[(x[at] != u) | (y[at] != v)]
        if not len(at):
            break
    return x, y


def unproject(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float, k1: float, k2: float, p1: float, p2: float, steps: int = 20) -> tuple[Column, Column]:
    """Fixed-point inverse of the distortion, in batches; a lambda of this size, forty times a row, isn't compiled."""

    @F.pandas_udf("x double, y double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            x, y = undistorted(a.to_numpy(float), b.to_numpy(float), k1, k2, p1, p2, steps)
        return pd.DataFrame({"x": x, "y": y})

    known = u.isNotNull() & v.isNotNull()
    out = run((u - cx) / fx, (v - cy) / fy)
    # batches show what isn't a number as null
    return tuple(F.when(known, F.coalesce(out[c], F.lit(float("nan")))) for c in "xy")


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


# fixed values: the published polynomial fit of the turbo colour map, by channel
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def turbo(x: Column) -> Vec:
    out = []
    for c in TURBO:
        y = F.lit(c[5])
        for k in reversed(c[:5]):
            y = y * x + k
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))
    return tuple(out)


def photometric(v: Column, exposure: Column, gain: Column, reference: float) -> Column:
    return v * reference / (exposure * gain)


# --- grids, arrays, keys


def voxel_key(*columns: Column, edge: float) -> list[Column]:
    """floor(x / edge), right for negative values too."""
    return [F.floor(c / edge).cast("long") for c in columns]


def azimuth_deg(x: Column, y: Column) -> Column:
    a = F.degrees(F.atan2(y, x))
    return F.when(a < 0, a + 360).otherwise(a)


def circshift(a: Column, k: int) -> Column:
    """Moved right by k places, the end coming round."""
    n = F.size(a)
    s = F.pmod(F.lit(k), n)
    return F.concat(F.slice(a, n - s + 1, s), F.slice(a, 1, n - s))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def health_bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), code)


def gradient(value: str, order, dt: Column) -> Column:
    """Central differences, one-sided at both ends."""
    before, after, here = F.lag(value).over(order), F.lead(value).over(order), F.col(value)
    return F.when(before.isNull(), (after - here) / dt).when(after.isNull(), (here - before) / dt).otherwise((after - before) / 2 / dt)
