"""SE(3) on whole batches: poses are rows (qx, qy, qz, qw, tx, ty, tz), tangents (rho, phi).

Logarithms and what builds on them would repeat their inputs many times over as Column expressions, so
these run as Arrow-batched numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POSE = ("qx", "qy", "qz", "qw", "tx", "ty", "tz")
TANGENT = ("r0", "r1", "r2", "p0", "p1", "p2")


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cross products of rows, without the checks that cost more than the numbers of a small batch."""
    out = np.empty((len(b) if len(a) == 1 else len(a), 3))
    for i, (j, k) in enumerate(((1, 2), (2, 0), (0, 1))):
        out[:, i] = a[:, j] * b[:, k] - a[:, k] * b[:, j]
    return out


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a[:, 3:] * b[:, :3] + b[:, 3:] * a[:, :3] + cross(a[:, :3], b[:, :3])
    return np.concatenate([v, a[:, 3:] * b[:, 3:] - (a[:, :3] * b[:, :3]).sum(1, keepdims=True)], axis=1)


def turn(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    c = cross(q[:, :3], v)
    return v + 2 * (q[:, 3:] * c + cross(q[:, :3], c))


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([multiply(a[:, :4], b[:, :4]), turn(a[:, :4], b[:, 4:]) + a[:, 4:]], axis=1)


def inverse(a: np.ndarray) -> np.ndarray:
    q = a[:, :4] * np.array([-1, -1, -1, 1])
    return np.concatenate([q, -turn(q, a[:, 4:])], axis=1)


def exp(xi: np.ndarray) -> np.ndarray:
    rho, phi = xi[:, :3], xi[:, 3:]
    th = np.linalg.norm(phi, axis=1, keepdims=True)
    small, safe = th < 1e-6, np.where(th < 1e-6, 1.0, th)
    k = np.where(small, 0.5, np.sin(safe / 2) / safe)
    a, b = np.where(small, 0.5, (1 - np.cos(safe)) / safe**2), np.where(small, 1 / 6, (safe - np.sin(safe)) / safe**3)
    w = cross(phi, rho)
    return np.concatenate([phi * k, np.cos(th / 2), rho + a * w + b * cross(phi, w)], axis=1)


def log(pose: np.ndarray) -> np.ndarray:
    q = np.where(pose[:, 3:4] < 0, -pose[:, :4], pose[:, :4])
    n = np.linalg.norm(q[:, :3], axis=1, keepdims=True)
    phi = q[:, :3] * np.where(n < 1e-9, 2.0, 2 * np.arctan2(n, q[:, 3:]) / np.where(n < 1e-9, 1.0, n))
    th = np.linalg.norm(phi, axis=1, keepdims=True)
    small, safe = th < 1e-4, np.where(th < 1e-4, 1.0, th)
    b = np.where(small, 1 / 12, 1 / safe**2 - (1 + np.cos(safe)) / (2 * safe * np.where(small, 1.0, np.sin(safe))))
    w = cross(phi, pose[:, 4:])
    return np.concatenate([pose[:, 4:] - 0.5 * w + b * cross(phi, w), phi], axis=1)


def boxplus(pose: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Perturbed on the right."""
    return compose(pose, exp(xi))


def boxminus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log(compose(inverse(b), a))


def interpolate(a: np.ndarray, b: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return boxplus(a, boxminus(b, a) * np.clip(beta, 0, 1))


def adjoint(pose: np.ndarray) -> np.ndarray:
    """(rows, 6, 6), translation first."""
    n = len(pose)
    r = np.stack([turn(pose[:, :4], np.tile(e, (n, 1))) for e in np.eye(3)], axis=2)
    t = pose[:, 4:]
    hat = np.zeros((n, 3, 3))
    hat[:, 0, 1], hat[:, 0, 2], hat[:, 1, 0], hat[:, 1, 2], hat[:, 2, 0], hat[:, 2, 1] = -t[:, 2], t[:, 1], t[:, 2], -t[:, 0], -t[:, 1], t[:, 0]
    out = np.zeros((n, 6, 6))
    out[:, :3, :3], out[:, 3:, 3:], out[:, :3, 3:] = r, r, hat @ r
    return out


def right_jacobian_inverse(xi: np.ndarray) -> np.ndarray:
    """(rows, 6, 6): how log(exp(xi) exp(d)) changes with a small d; the series in the adjoint, for turns well below two pi."""
    n = len(xi)
    ad = np.zeros((n, 6, 6))
    for at, v in (((0, 0), xi[:, 3:]), ((3, 3), xi[:, 3:]), ((0, 3), xi[:, :3])):
        for (i, j), s, k in (((0, 1), -1, 2), ((0, 2), 1, 1), ((1, 0), 1, 2), ((1, 2), -1, 0), ((2, 0), -1, 1), ((2, 1), 1, 0)):
            ad[:, at[0] + i, at[1] + j] = s * v[:, k]
    square = ad @ ad
    # Bernoulli numbers over factorials
    out, power = np.eye(6) + ad / 2, np.broadcast_to(np.eye(6), ad.shape)
    for c in (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160):
        power = power @ square
        out = out + c * power
    return out


def psd_clamp(m: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Symmetrised, with eigenvalues of at least ``least``."""
    value, vector = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    return (vector * np.maximum(value, least)[..., None, :]) @ np.swapaxes(vector, -1, -2)


def batched(f, names: tuple[str, ...], *columns: Column) -> Column:
    """f over an array of the columns (rows, len(columns)), as a struct of doubles ``names``."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(*series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(f(np.stack([s.to_numpy(float) for s in series], axis=1)), columns=list(names))

    return run(*columns)
