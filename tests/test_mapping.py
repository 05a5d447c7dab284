"""Rebuild closures, against brute force and in crowded tiles."""

import random

import pytest
from posegrid.operators import mapping
from pyspark.sql import functions as F

BOX = "id long, min_x double, max_x double, min_y double, max_y double"


@pytest.mark.parametrize("size", [0.5, 4.0, 30.0])
def test_closure_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = []
    for i in range(150):
        x, y = rng.choice((rng.uniform(-50, 50), float(rng.randrange(-5, 5) * 10))), rng.uniform(-50, 50)
        rows.append((i, x, x + rng.uniform(0, size), y, y + rng.uniform(0, size)))
    changed = [r for r in rows if r[0] % 30 == 0]
    want = {r[0] for r in rows if any(r[1] <= c[2] + 1 and r[2] >= c[1] - 1 and r[3] <= c[4] + 1 and r[4] >= c[3] - 1 for c in changed)}
    got = mapping.rebuild_closure(spark.createDataFrame(rows, BOX), spark.createDataFrame(changed, BOX), 1.0, 10.0).collect()
    assert sorted(r["id"] for r in got) == sorted(want)


def test_crowded_tiles_are_not_compared(spark):
    """300,000 boxes and 60,000 changed ones in one tile: 18 billion pairs."""
    at = [F.lit(v).alias(n) for n, v in (("min_x", 5.0), ("max_x", 6.0), ("min_y", 5.0), ("max_y", 6.0))]
    changed = spark.range(60_000).select("id", *at)
    assert mapping.rebuild_closure(spark.range(300_000).select("id", *at), changed, 5.5, 10.0).count() == 300_000
