"""Joins whose sides grow with the tables aren't broadcast, however small Spark takes them for."""

import pytest
from posegrid.operators import graph, joins

POSED = ", ".join(f"{c} double" for c in graph.POSE)


def of(spark, kind):
    """A table that Spark knows to be small."""
    return spark.range(2).selectExpr(*[f"cast(id as {k}) as {n}" for n, k in (c.split() for c in kind.split(", "))])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_revisits_are_shuffled(spark):
    poses = of(spark, "run int, n long, t long, x double, y double")
    assert "Broadcast" not in plan(joins.revisit_candidates(poses, 1, 0, 1.0, ["run"]))


@pytest.mark.parametrize("step", ["pairs", "decide"])
def test_loop_consistency_is_shuffled(spark, step):
    loops = of(spark, f"run long, loop long, from_id long, to_id long, {POSED}, variance double, in_graph boolean")
    found = graph.pcm_pairs(loops, of(spark, f"run long, id long, {POSED}"), 1e-4) if step == "pairs" else graph.pcm_decide(loops, of(spark, "run long, loop long"))
    assert "Broadcast" not in plan(found)


def test_fusion_reads_its_points_once(spark):
    from posegrid.plans import catalogue

    text = plan(catalogue.queries()["gpu_fuse"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in text and text.count("Scan parquet") == 1
