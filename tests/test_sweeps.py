"""Sweeps' samples and events by ordered passes, against brute force and pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from posegrid.operators import joins
from pyspark.sql import functions as F

SWEEP = "sweep_id long, t_begin long, t_end long"


def sweeps_of(rng, n):
    return [(i, t, t + rng.choice((-3, 0, 2, 9, 30))) for i, t in enumerate(rng.choices(range(120), k=n))]


@pytest.mark.parametrize("seed", [1, 2])
def test_events_go_to_the_earliest_sweep_that_holds_them(spark, seed):
    rng = random.Random(seed)
    sweeps = sweeps_of(rng, 25)
    events = [(i, s) for i, s in enumerate(rng.choices(range(-5, 160), k=120))]
    got = joins.assigned_once(spark.createDataFrame(sweeps, SWEEP), spark.createDataFrame([*events, events[0], (999, None)], "event_id long, stamp_us long"), 10)
    want = {e: min((b, i) for i, b, t in sweeps if b <= s <= t)[1] for e, s in events if any(b <= s <= t for _, b, t in sweeps)}
    assert sorted((r["event_id"], r["sweep_id"]) for r in got.collect()) == sorted(want.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_of_samples_are_those_of_their_rows(spark, seed):
    rng = random.Random(seed)
    sweeps = spark.createDataFrame(sweeps_of(rng, 25), SWEEP)
    imu = spark.createDataFrame([(i, s, rng.choice((None, 1.5, rng.random()))) for i, s in enumerate(rng.choices(range(-5, 160), k=90))], "event_id long, stamp_us long, value double")
    rows = joins.sweep_imu(sweeps, imu, 10).join(imu.select("event_id", "value"), "event_id")
    want = rows.groupBy("sweep_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("straddler"), F.col("stamp_us"))).alias("t"), F.avg("value").alias("m")).collect()
    got = {r["sweep_id"]: r for r in joins.sweep_imu_sums(sweeps, imu, 10).collect()}
    assert set(got) == {r["sweep_id"] for r in want}
    for r in want:
        g = got[r["sweep_id"]]
        assert (g["n_imu"], g["straddler_stamp"]) == (r["n"], r["t"])
        assert g["mean_value"] is None if r["m"] is None else math.isclose(g["mean_value"], r["m"], abs_tol=1e-12)


def test_dense_sweeps_make_no_pairs(spark):
    """400 sweeps that all hold 400 events: 160,000 pairs, which no step of the plan may put out."""
    sweeps, events = spark.range(400).selectExpr("id as sweep_id", "id as t_begin", "id + 1000 as t_end"), spark.range(400).selectExpr("id as event_id", "id + 500 as stamp_us")
    found = joins.assigned_once(sweeps, events, 1000)
    assert {r["sweep_id"] for r in found.collect()} == {0} and found.count() == 400
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_forward_matches_take_one_pass(spark):
    """No frame reaches to the end of its partition: Spark goes through such a one again for each row."""
    rng = np.random.default_rng(12)
    left = pd.DataFrame({"k": rng.integers(0, 3, 400), "s": rng.integers(0, 300, 400), "i": np.arange(400)})
    right = pd.DataFrame({"k": rng.integers(0, 3, 90), "s": rng.integers(0, 300, 90), "v": rng.integers(0, 1000, 90)})
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    for by, strict, width in (["k"], False, None), (["k"], True, 20), ([], False, 20), ([], True, None):
        found = joins.asof_forward(a, b, "s", ["v"], by, strict, width)
        assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        got = {r["i"]: r["v"] for r in found.collect()}
        for k, s, i in left.itertuples(index=False):
            ahead = right[(right["s"] > s if strict else right["s"] >= s) & ((right["k"] == k) if by else True)].sort_values(["s", "v"])
            assert got[i] == (ahead["v"].iloc[0] if len(ahead) else None)
