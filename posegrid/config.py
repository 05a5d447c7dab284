"""Settings as frozen dataclasses: defaults survive, choices are closed, ranges are checked on load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Preprocess:
    blind: float = 0.5
    det_range: float = 120.0
    filter_num: int = 1
    voxel_mode: str = "centre"
    nonfinite_warn_ratio: float = 0.05


@dataclass(frozen=True)
class Align:
    reorder_ms: float = 20.0
    max_wait_ms: float = 150.0
    gap_seconds: float = 0.5


@dataclass(frozen=True)
class FrontEnd:
    voxel_edge: float = 1.0
    max_correspondence: float = 0.5
    convergence_eps: float = 1e-5
    max_iterations: int = 100
    keyframe_distance: float = 1.0
    keyframe_degrees: float = 10.0
    keyframe_seconds: float = 1.0


@dataclass(frozen=True)
class BackEnd:
    huber_k: float = 1.345
    pcm_alpha: float = 0.99
    gnss_min_rank: int = 2
    loop_min_fitness: float = 0.3


@dataclass(frozen=True)
class Place:
    rings: int = 20
    sectors: int = 60
    max_range: float = 80.0
    knn: int = 10
    threshold: float = 0.13


@dataclass(frozen=True)
class Config:
    preprocess: Preprocess = field(default_factory=Preprocess)
    align: Align = field(default_factory=Align)
    frontend: FrontEnd = field(default_factory=FrontEnd)
    backend: BackEnd = field(default_factory=BackEnd)
    place: Place = field(default_factory=Place)


CHOICES = {"voxel_mode": ("centre", "first", "reservoir", "off")}
POSITIVE = ("det_range", "filter_num", "max_wait_ms", "voxel_edge", "max_correspondence", "convergence_eps", "max_iterations", "keyframe_distance", "huber_k", "rings", "sectors", "max_range", "knn", "threshold")
SHARES = ("nonfinite_warn_ratio", "pcm_alpha", "loop_min_fitness")


def merged(base: Any, given: dict) -> Any:
    """``base`` with the given settings; an unknown name or a value of another type is an error."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    out = {}
    for k, v in given.items():
        if k not in known:
            raise ConfigError(f"unknown setting {k}")
        if is_dataclass(known[k]):
            out[k] = merged(known[k], v)
        elif isinstance(known[k], float) and isinstance(v, int | float) and not isinstance(v, bool):
            out[k] = float(v)
        elif type(v) is type(known[k]):
            out[k] = v
        else:
            raise ConfigError(f"{k} should be {type(known[k]).__name__}")
    return replace(base, **out)


def validate(cfg: Config) -> Config:
    """The same settings, or an error that names all that is out of range."""
    bad = []
    for name, part in asdict(cfg).items():
        for k, v in part.items():
            if k in CHOICES and v not in CHOICES[k]:
                bad.append(f"{name}.{k} is none of {', '.join(CHOICES[k])}")
            if k in POSITIVE and not v > 0:
                bad.append(f"{name}.{k} should be above 0")
            if k in SHARES and not 0 <= v <= 1:
                bad.append(f"{name}.{k} should be from 0 to 1")
    if cfg.preprocess.blind >= cfg.preprocess.det_range:
        bad.append("preprocess.blind should be below det_range")
    if cfg.align.reorder_ms > cfg.align.max_wait_ms:
        bad.append("align.reorder_ms should be at most max_wait_ms")
    if cfg.frontend.max_correspondence > cfg.frontend.voxel_edge:
        bad.append("frontend.max_correspondence should be at most voxel_edge, as only neighbouring cells are searched")
    if bad:
        raise ConfigError("; ".join(bad))
    return cfg


def load(text: str) -> Config:
    """Settings from JSON text; whatever isn't named keeps its default."""
    return validate(merged(Config(), json.loads(text)))
