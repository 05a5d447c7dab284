"""Admission of keyframes to a pose graph: which packets become vertices and edges, and with what covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from posegrid.functions import manifold
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import streamed_fold

LEAST_EIGENVALUE = 1e-9
#: From translation-first to rotation-first axes.
SWAP = [3, 4, 5, 0, 1, 2]


def inflation(score: np.ndarray, most: float, power: float, weak: float, lock: bool) -> tuple[np.ndarray, np.ndarray]:
    """(factors, locked): how much the variance along each rotation-first axis grows with a lack of observability (scores are translation-first)."""
    s = np.clip(score[:, SWAP], 0.0, 1.0)
    held = (s < weak) & lock
    return np.where(held, most, 1 + (most - 1) * (1 - s) ** power), held.any(axis=1)


def inflate(cov: np.ndarray, factors: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Covariances with the axes of ``basis`` (columns; rotation-first, None: the frame's own) stretched by ``factors``."""
    root = np.sqrt(factors)
    if basis is None:
        out = root[:, :, None] * cov * root[:, None, :]
    else:
        back = basis.transpose(0, 2, 1)
        out = basis @ (root[:, :, None] * (back @ cov @ basis) * root[:, None, :]) @ back
    return (out + out.transpose(0, 2, 1)) / 2


def edge_covariances(cov: np.ndarray, information: np.ndarray, score: np.ndarray, basis: np.ndarray, has_basis: np.ndarray, usable: np.ndarray, most: float, power: float, weak: float, lock: bool) -> dict[str, np.ndarray]:
    """Covariances of accepted edges: information is inverted, then inflated where the scores' frame is ``usable``, then held positive."""
    cov = cov.copy()
    if information.any():
        cov[information] = np.linalg.inv(manifold.psd_clamp(cov[information], LEAST_EIGENVALUE))
    factors, locked = inflation(score, most, power, weak, lock)
    factors = np.where(usable[:, None], factors, 1.0)
    turned = basis[:, SWAP][:, :, SWAP]
    grown = np.where((usable & has_basis)[:, None, None], inflate(cov, factors, turned), inflate(cov, factors))
    grown = np.where(usable[:, None, None], grown, (cov + cov.transpose(0, 2, 1)) / 2)
    clamped = np.linalg.eigvalsh(grown)[:, 0] < LEAST_EIGENVALUE
    grown[clamped] = manifold.psd_clamp(grown[clamped], LEAST_EIGENVALUE)
    return {"cov": grown, "locked": locked & usable, "clamped": clamped}


def verdicts(packets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, id, verdict and rel_to of each packet (keys, ``order``, id, kind, rel_to, kinematics), in order of arrival.

    prior: the first absolute one; ignored: any later absolute one; between and bridge: relative to the last accepted
    packet; broken: relative to another, before the prior, or a bridge without kinematics; unknown: any other kind.
    Only accepted packets move on what the next one must be relative to.
    """

    def step(s: dict, r: dict) -> dict:
        kind, last = r["kind"], s["last"]
        follows = last is not None and r["rel_to"] == last
        if kind == "absolute":
            verdict = "prior" if last is None else "ignored"
        elif kind in ("between", "imu"):
            verdict = "broken" if not follows or (kind == "imu" and not r["kinematics"]) else "between" if kind == "between" else "bridge"
        else:
            verdict = "unknown"
        return {"verdict": verdict, "last": r["id"] if verdict in ("prior", "between", "bridge") else last}

    slim = packets.select(*dict.fromkeys([*keys, *order, "id", "kind", "rel_to", "kinematics"]))
    return streamed_fold(slim, keys, order, {"verdict": None, "last": None}, step, ["id", "rel_to"], "verdict string, last bigint").drop("last")


def admit_keyframes(packets: DataFrame, keys: list[str], order: list[str], most: float = 1e4, power: float = 2.0, weak: float = 0.05, lock: bool = True) -> DataFrame:
    """One row for each packet: keys, id, verdict, rel_to, and for accepted between-edges inverted, inflated, locked, clamped and cov (36 values, rotation first).

    Packets carry kind, rel_to, kinematics, form ('information' or 'covariance'), cov (36), frame, score (6, translation
    first) and basis (36, null: none). Scores that are neither in the body's frame nor carry a basis don't inflate. The
    verdicts are a fold with one id of state a key; matrices are worked out in batches wherever the packets lie. Ids are
    unique within a key.
    """
    found = verdicts(packets, keys, order)
    names = ["inverted", "inflated", "locked", "clamped", "cov"]
    body = [*keys, "id"]
    edges = packets.select(*body, "kind", "form", "cov", "frame", "score", "basis").filter("kind = 'between'").drop("kind").join(found.filter("verdict = 'between'").select(*body), body, "left_semi")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*body).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            matrix = lambda c: np.stack(batch.column(c).to_pandas().to_numpy()).astype(float).reshape(n, 6, 6)  # noqa: E731, B023
            information = np.array([f == "information" for f in batch.column("form").to_pylist()])
            has_basis = ~np.array(batch.column("basis").is_null().to_pylist())
            basis = np.stack([np.eye(6) if b is None else np.array(b, float).reshape(6, 6) for b in batch.column("basis").to_pylist()])
            usable = has_basis | np.array([f == "body" for f in batch.column("frame").to_pylist()])
            score = np.stack(batch.column("score").to_pandas().to_numpy()).astype(float)
            got = edge_covariances(matrix("cov"), information, score, basis, has_basis, usable, most, power, weak, lock)
            made = [pa.array(information), pa.array(usable), pa.array(got["locked"]), pa.array(got["clamped"]), pa.array(list(got["cov"].reshape(n, 36)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in body), *made], [*body, *names])

    made = edges.mapInArrow(run, f"{kinds}, inverted boolean, inflated boolean, locked boolean, clamped boolean, cov array<double>")
    return found.join(made, body, "left").select(*body, "verdict", F.when(F.col("verdict").isin("between", "bridge"), F.col("rel_to")).alias("rel_to"), *names)
