"""Settings: defaults survive, types and choices are closed, and ranges and cross-field rules are checked for whole tables of configurations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of all settings that a rule looks at, and their defaults.
SETTINGS: dict[str, float | int | str | bool] = {
    "map.tsdf_voxel_m": 0.1, "map.reg_voxel_m": 0.5,
    "preprocess.lidar.voxel_surf_m": 0.4, "preprocess.lidar.blind": 0.5, "preprocess.lidar.det_range": 120.0, "preprocess.lidar.point_filter_num": 1, "preprocess.lidar.sweep_floor_frac": 0.5, "preprocess.lidar.surf_max_pts": 20000,
    "preprocess.camera.pyramid_levels": 1, "preprocess.camera.rectify_balance": 0.0,
    "frontend.lio.voxel_size_m": 1.0, "frontend.lio.max_points_per_voxel": 20, "frontend.lio.max_range_m": 100.0, "frontend.lio.keypoint_voxel_factor": 1.5, "frontend.lio.min_keypoints": 30, "frontend.lio.icp_max_iterations": 100,
    "frontend.lio.convergence_eps": 1e-5, "frontend.lio.max_corr_dist_m": 0.5, "frontend.lio.min_beta": 200.0, "frontend.lio.max_expected_jerk": 3.0, "frontend.lio.init_stationary_s": 1.0, "frontend.lio.max_gap_s": 0.5,
    "frontend.lio.reseed_cov_inflation": 100.0, "frontend.lio.gyro_bias_gain": 0.0, "frontend.lio.gyro_bias_max": 0.1,
    "backend.anchor_sigma": 0.01, "backend.extra_iters_normal": 0, "backend.extra_iters_loop": 2, "backend.optimize_interval_ms": 100.0, "backend.queue_warn_depth": 8, "backend.obs_inflation_max": 1e4, "backend.obs_inflation_gamma": 2.0,
    "backend.degenerate_thresh": 0.05, "backend.loop_min_fitness": 0.3, "backend.pcm_chi2_alpha": 0.99, "backend.pcm_max_nodes": 64, "backend.loop_huber_k": 1.345, "backend.gnss_huber_k": 1.345, "backend.gnc_reject_w": 0.1,
    "backend.gnc_anneal_steps": 10, "backend.gnc_consolidate_interval": 0, "backend.gnss_max_cov": 25.0, "backend.gnss_min_baseline": 10.0, "backend.gnss_min_excitation": 5.0, "backend.gnss_min_speed": 0.3,
    "backend.gnss_min_moving_fixes": 10, "backend.gnss_datum_yaw_sigma_max": 5.0, "backend.gnss_skip_confidence_k": 3.0, "backend.gnss_min_spacing": 1.0, "backend.gnss_reacq_persist": 3, "backend.gnss_redistribute_span_max": 100,
    "backend.extrinsic_prior_sigma": 0.1, "backend.extrinsic_refine_sigma": 0.01, "backend.extrinsic_excite_rot": 1.0, "backend.extrinsic_excite_trans": 5.0, "backend.extrinsic_freeze_cov": 1e-6, "backend.extrinsic_max_dev": 0.1,
    "backend.reintegrate_thresh": 0.0, "backend.loop_gate_k": 3.0, "backend.imu.acc_noise": 0.01, "backend.imu.gyr_noise": 0.001, "backend.imu.acc_bias_rw": 1e-4, "backend.imu.gyr_bias_rw": 1e-5,
    "place.sc_Nr": 20, "place.sc_Ns": 60, "place.sc_rmax": 80.0, "place.submap_window": 5, "place.submap_voxel": 0.3, "place.submap_cache": 16, "place.detect_period_kf": 1, "place.gicp_num_threads": 1, "place.gicp_fitness_min": 0.3,
    "place.gicp_overlap_min": 0.3, "place.pcm_chi2_conf": 0.99,
    "sensors.lidar.nominal_rate_hz": 10.0, "sensors.lidar.ptp": False, "sensors.imu.rate_hz": 200.0, "sensors.camera.shutter": "global", "sensors.camera.distortion_model": "radtan",
    "aggregation.max_wait_ms": 150.0, "time.source": "host",
    "pipeline.threads.frontend": 1, "pipeline.threads.backend": 1, "pipeline.threads.map": 1, "pipeline.queue.meas_capacity": 8, "pipeline.queue.kf_capacity": 64, "pipeline.queue.map_capacity": 64,
    "debug.assoc.max_hz": 0.0, "debug.solver.max_hz": 0.0, "debug.lio.max_hz": 0.0, "debug.map_health.max_hz": 0.0, "debug.path_sample_hz": 10.0, "debug.path_publish_hz": 1.0, "debug.path_max_poses": 20000,
}
ABOVE_ZERO = (
    "map.tsdf_voxel_m map.reg_voxel_m preprocess.lidar.voxel_surf_m preprocess.lidar.det_range frontend.lio.voxel_size_m frontend.lio.max_range_m frontend.lio.keypoint_voxel_factor frontend.lio.convergence_eps frontend.lio.max_corr_dist_m "
    "frontend.lio.min_beta frontend.lio.max_expected_jerk frontend.lio.max_gap_s frontend.lio.gyro_bias_max backend.anchor_sigma backend.optimize_interval_ms backend.obs_inflation_gamma backend.loop_huber_k backend.gnss_huber_k "
    "backend.gnss_max_cov backend.gnss_min_baseline backend.gnss_min_excitation backend.gnss_min_speed backend.gnss_datum_yaw_sigma_max backend.gnss_skip_confidence_k backend.extrinsic_prior_sigma backend.extrinsic_refine_sigma "
    "backend.extrinsic_excite_rot backend.extrinsic_excite_trans backend.extrinsic_freeze_cov backend.extrinsic_max_dev backend.loop_gate_k backend.imu.acc_noise backend.imu.gyr_noise backend.imu.acc_bias_rw backend.imu.gyr_bias_rw "
    "place.sc_rmax place.submap_voxel sensors.lidar.nominal_rate_hz sensors.imu.rate_hz debug.path_publish_hz"
).split()
ONE_OR_MORE = (
    "preprocess.lidar.point_filter_num preprocess.lidar.surf_max_pts preprocess.camera.pyramid_levels frontend.lio.max_points_per_voxel frontend.lio.min_keypoints frontend.lio.icp_max_iterations frontend.lio.reseed_cov_inflation "
    "backend.queue_warn_depth backend.obs_inflation_max backend.pcm_max_nodes backend.gnc_anneal_steps backend.gnss_min_moving_fixes backend.gnss_reacq_persist backend.gnss_redistribute_span_max place.sc_Nr place.sc_Ns place.submap_window "
    "place.submap_cache place.detect_period_kf place.gicp_num_threads pipeline.threads.frontend pipeline.threads.backend pipeline.threads.map pipeline.queue.meas_capacity pipeline.queue.kf_capacity pipeline.queue.map_capacity debug.path_max_poses"
).split()
ZERO_OR_MORE = "preprocess.lidar.blind frontend.lio.init_stationary_s backend.extra_iters_normal backend.extra_iters_loop backend.gnc_consolidate_interval backend.gnss_min_spacing backend.reintegrate_thresh debug.assoc.max_hz debug.solver.max_hz debug.lio.max_hz debug.map_health.max_hz".split()
#: Bounds, and whether each belongs to the range.
RANGES = (
    [(n, 0, True, 1, True) for n in ("frontend.lio.gyro_bias_gain", "backend.degenerate_thresh", "backend.loop_min_fitness", "place.gicp_overlap_min", "preprocess.camera.rectify_balance")]
    + [(n, 0, False, 1, False) for n in ("backend.pcm_chi2_alpha", "place.pcm_chi2_conf", "backend.gnc_reject_w")]
    + [(n, 0, False, 1, True) for n in ("place.gicp_fitness_min", "preprocess.lidar.sweep_floor_frac")]
    + [("debug.path_sample_hz", 0, False, 200, True)]
)
CHOICES = {
    "sensors.camera.shutter": ("global",), "sensors.camera.distortion_model": ("none", "radtan", "plumb_bob", "equidistant", "equi"), "time.source": ("host", "ptp", "gnss"),
}
#: What holds between settings, as SQL over their quoted names.
BETWEEN = {
    "map.tsdf_voxel_m must be at most preprocess.lidar.voxel_surf_m": "{map.tsdf_voxel_m} <= {preprocess.lidar.voxel_surf_m}",
    "map.tsdf_voxel_m must be at most map.reg_voxel_m": "{map.tsdf_voxel_m} <= {map.reg_voxel_m}",
    "place.pcm_chi2_conf must equal backend.pcm_chi2_alpha": "{place.pcm_chi2_conf} = {backend.pcm_chi2_alpha}",
    "preprocess.lidar.blind must be below preprocess.lidar.det_range": "{preprocess.lidar.blind} < {preprocess.lidar.det_range}",
    "aggregation.max_wait_ms must be one lidar period at least": "{sensors.lidar.nominal_rate_hz} <= 0 OR {aggregation.max_wait_ms} * {sensors.lidar.nominal_rate_hz} >= 1000",
    "time.source ptp needs a sensor with ptp": "{time.source} <> 'ptp' OR {sensors.lidar.ptp}",
}


def rules() -> dict[str, str]:
    """Message and condition (SQL, settings in braces) of every rule, in a fixed order."""
    out = {f"{n} must be above 0": f"{{{n}}} > 0" for n in ABOVE_ZERO}
    out |= {f"{n} must be 1 or more": f"{{{n}}} >= 1" for n in ONE_OR_MORE} | {f"{n} must be 0 or more": f"{{{n}}} >= 0" for n in ZERO_OR_MORE}
    for n, low, with_low, high, with_high in RANGES:
        out[f"{n} must lie in {'[' if with_low else '('}{low}, {high}{']' if with_high else ')'}"] = f"{{{n}}} {'>=' if with_low else '>'} {low} AND {{{n}}} {'<=' if with_high else '<'} {high}"
    for n, known in CHOICES.items():
        out[f"{n} must be one of {', '.join(known)}"] = f"{{{n}}} IN ({', '.join(repr(k) for k in known)})"
    return out | BETWEEN


def _kind(value: object) -> str:
    return {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]


def _schema(names: list[str], depth: int = 0) -> str:
    """The nested schema of dotted names."""
    parts: dict[str, list[str]] = {}
    for n in names:
        parts.setdefault(n.split(".")[depth], []).append(n)
    fields = (f"`{k}`: {_kind(SETTINGS[v[0]])}" if len(v) == 1 and v[0].count(".") == depth else f"`{k}`: {_schema(v, depth + 1)}" for k, v in parts.items())
    return f"struct<{', '.join(fields)}>"


def resolved(configs: DataFrame, text: str) -> DataFrame:
    """``configs`` with a column for each setting (its dotted name), from JSON texts; what a text doesn't name, or names with another type, has its default.

    Unreadable and null texts give the defaults, and readable is false.
    """
    parsed = configs.withColumn("_c", F.from_json(text, _schema(list(SETTINGS))))
    value = lambda n, default: F.coalesce(F.col(".".join(f"`{p}`" for p in ["_c", *n.split(".")])), F.lit(default)).alias(n)
    return parsed.select(*configs.columns, F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False)).alias("readable"), *[value(n, d) for n, d in SETTINGS.items()])


def broken(known: DataFrame) -> Column:
    """The messages of all rules that the settings (columns under their dotted names) break, in order of the rules."""
    quoted = {n: f"`{n}`" for n in SETTINGS}

    def condition(sql: str) -> Column:
        for n, q in quoted.items():
            sql = sql.replace(f"{{{n}}}", q)
        return F.expr(sql)

    return F.array_compact(F.array(*[F.when(~condition(sql), message) for message, sql in rules().items()]))


class ConfigError(ValueError):
    pass


def load(text: str) -> dict[str, float | int | str | bool]:
    """One configuration on the driver: all settings by dotted name; unknown names and values of another type are errors."""
    out = dict(SETTINGS)

    def walk(part: dict, before: str) -> None:
        for k, v in part.items():
            name = f"{before}{k}"
            if isinstance(v, dict):
                if not any(n.startswith(f"{name}.") for n in SETTINGS):
                    raise ConfigError(f"unknown section {name}")
                walk(v, f"{name}.")
            elif name not in SETTINGS:
                raise ConfigError(f"unknown setting {name}")
            elif type(SETTINGS[name]) is float and type(v) in (int, float):
                out[name] = float(v)
            elif type(v) is not type(SETTINGS[name]):
                raise ConfigError(f"{name} should be {type(SETTINGS[name]).__name__}")
            else:
                out[name] = v

    walk(json.loads(text), "")
    return out
