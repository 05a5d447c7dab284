"""Map operators: rebuild closures, meshing, versions of keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import in_buckets


def rebuild_closure(boxes: DataFrame, changed: DataFrame, margin: float, tile: float) -> DataFrame:
    """Ids of boxes (id, min_x, max_x, min_y, max_y) that meet a changed box grown by ``margin``; both sides meet in tiles of the plane.

    A box in a tile that a grown box covers needs no comparison, so crowded tiles cost no more than their rows.
    """
    grown = changed.select(*[(F.col(f"min_{a}") - margin).alias(f"lo_{a}") for a in "xy"], *[(F.col(f"max_{a}") + margin).alias(f"hi_{a}") for a in "xy"])
    left = in_buckets(in_buckets(boxes, "min_x", "max_x", tile, "tx"), "min_y", "max_y", tile, "ty")
    right = in_buckets(in_buckets(grown, "lo_x", "hi_x", tile, "tx"), "lo_y", "hi_y", tile, "ty")
    whole = " and ".join(f"lo_{a} < t{a} * {tile!r}D and hi_{a} > (t{a} + 1) * {tile!r}D" for a in "xy")
    covered = right.filter(whole).select("tx", "ty").distinct()
    inside = left.join(covered, ["tx", "ty"], "left_semi").select("id").distinct()
    rest = left.join(inside, "id", "left_anti").join(right.join(covered, ["tx", "ty"], "left_anti"), ["tx", "ty"])
    near = rest.filter("min_x <= hi_x and max_x >= lo_x and min_y <= hi_y and max_y >= lo_y")
    return inside.unionByName(near.select("id")).distinct()


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of each key: an upsert as a query."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), version).alias("r")).select(key, "r.*")
