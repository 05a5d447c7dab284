"""Interval, as-of, bracket, grid-neighbour, range, semi and anti joins.

Catalyst has no range or as-of operator, so each is rewritten to an equi-join or a window that
partitions: ranges meet in time buckets, neighbours in grid cells, and as-of matches come from one
ordered pass over both sides.
"""

from __future__ import annotations

from posegrid.settling import settle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_buckets(intervals: DataFrame, low: str, high: str, width: int, name: str = "bucket") -> DataFrame:
    """One row for each bucket of ``width`` that the closed interval meets."""
    return intervals.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def interval_join(intervals: DataFrame, events: DataFrame, low: str, high: str, stamp: str, width: int, open_low: bool = False) -> DataFrame:
    """Events with stamp in [low, high], or in (low, high]; equi-join on time buckets, so that no pair of far ones is looked at."""
    right = events.withColumn("bucket", F.floor(F.col(stamp) / width))
    after = F.col(stamp) > F.col(low) if open_low else F.col(stamp) >= F.col(low)
    return in_buckets(intervals, low, high, width).join(right, "bucket").filter(after & (F.col(stamp) <= F.col(high))).drop("bucket")


def asof_backward(left: DataFrame, right: DataFrame, stamp: str, values: list[str], by: list[str] | None = None, strict: bool = False, width: int | None = None) -> DataFrame:
    """For each left row the values of the last right row at or before its stamp (before, if strict), null if none.

    One union ordered by stamp, with the last right row carried on, partitioned by ``by``. With
    ``width`` it is partitioned by time buckets too, and what a bucket inherits comes from a table of
    one row per bucket; so one long stream without keys is no single task's work. Of right rows with
    equal stamps the one with the greatest values is last (and that with the least is first).
    """
    return _asof(left, right, stamp, values, by or [], True, strict, width)


def asof_forward(left: DataFrame, right: DataFrame, stamp: str, values: list[str], by: list[str] | None = None, strict: bool = False, width: int | None = None) -> DataFrame:
    """The same with the first right row at or after (after, if strict) the stamp."""
    return _asof(left, right, stamp, values, by or [], False, strict, width)


def _asof(left: DataFrame, right: DataFrame, stamp: str, values: list[str], by: list[str], backward: bool, strict: bool, width: int | None) -> DataFrame:
    # at equal stamps the right row comes first when it may match, and last when it may not
    side = 0 if backward != strict else 2
    packed = F.struct(*[F.col(v) for v in values])
    kind = right.select(packed.alias("v")).schema["v"].dataType
    other = right.select(*by, stamp, F.lit(side).alias("_side"), packed.alias("_right"))
    both = left.withColumn("_side", F.lit(1)).withColumn("_right", F.lit(None).cast(kind)).unionByName(other, allowMissingColumns=True)
    # the first one after a row is the last one before it in reverse; a frame that reaches to the end would be gone through again for each row
    ordered = (lambda w, *c: w.orderBy(*c)) if backward else (lambda w, *c: w.orderBy(*map(F.desc, c)))
    carry = lambda c, o, end: F.last(c, True).over(o.rowsBetween(Window.unboundedPreceding, end))
    keys = list(by)
    if width is not None:
        both = both.withColumn("_bucket", F.floor(F.col(stamp) / width))
        keys.append("_bucket")
        pick = F.max_by if backward else F.min_by
        ends = both.groupBy(*keys).agg(pick("_right", F.when(F.col("_side") != 1, F.struct(stamp, "_right"))).alias("_end"))
        ends = ends.select(*keys, carry("_end", ordered(Window.partitionBy(*by), "_bucket"), -1).alias("_inherited"))
    found = both.withColumn("_found", carry("_right", ordered(Window.partitionBy(*keys), stamp, "_side", "_right"), 0)).filter("_side = 1")
    if width is not None:
        found = found.join(ends, keys, "left").withColumn("_found", F.coalesce("_found", "_inherited"))
    return found.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, stamp: str, by: list[str], tolerance: float | None = None, closed: bool = True, tie: str = "earlier") -> DataFrame:
    """left with near_stamp: the right stamp nearest to its own within ``tolerance`` (closed or open; None: any); ties go to the earlier or later one."""
    r = right.select(*by, stamp, F.col(stamp).alias("_s")).distinct()
    both = asof_forward(asof_backward(left, r.withColumnRenamed("_s", "_before"), stamp, ["_before"], by), r.withColumnRenamed("_s", "_after"), stamp, ["_after"], by)
    a, b = F.col(stamp) - F.col("_before"), F.col("_after") - F.col(stamp)
    later = F.col("_before").isNull() | ((b < a) if tie == "earlier" else (b <= a))
    near = F.when(later & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before"))
    out = both.withColumn("near_stamp", near).drop("_before", "_after").withColumn("gap", F.abs(F.col(stamp) - F.col("near_stamp")))
    if tolerance is not None:
        out = out.filter(F.col("gap") <= tolerance if closed else F.col("gap") < tolerance)
    return out.filter("near_stamp is not null")


def bracket_join(fixes: DataFrame, keys: DataFrame, stamp: str, ident: str, by: list[str]) -> DataFrame:
    """Last key at or before a fix and first key after it, and where between them it lies; clamped at both ends."""
    k = keys.select(*by, stamp, F.struct(F.col(stamp).alias("s"), F.col(ident).alias("i")).alias("_k"))
    both = asof_forward(asof_backward(fixes, k.withColumnRenamed("_k", "_a"), stamp, ["_a"], by), k.withColumnRenamed("_k", "_b"), stamp, ["_b"], by, strict=True)
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    span = b["s"] - a["s"]
    beta = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(stamp) - a["s"]) / span))).otherwise(0.0)
    return both.withColumn("before_id", a["i"]).withColumn("after_id", b["i"]).withColumn("beta", beta).drop("_a", "_b").filter("before_id is not null")


def _bounded(sweeps: DataFrame, width: int) -> DataFrame:
    """sweeps with lower: the least of the previous sweep's end and the sweep's own start."""
    ends = sweeps.groupBy("t_begin").agg(F.max("t_end").alias("_end"))
    return asof_backward(sweeps, ends, "t_begin", ["_end"], strict=True, width=width).withColumn("lower", F.least("t_begin", F.coalesce("_end", "t_begin"))).drop("_end")


def _straddlers(bounded: DataFrame, imu: DataFrame, width: int, more: list[str]) -> DataFrame:
    """(sweep_id, event_id, stamp_us, more): the newest sample at or before t_begin, if it isn't after lower."""
    heads = bounded.select("sweep_id", "lower", F.col("t_begin").alias("stamp_us"))
    newest = imu.groupBy("stamp_us").agg(F.max("event_id").alias("event_id"), *[F.max_by(c, "event_id").alias(c) for c in more]).withColumn("_s", F.col("stamp_us"))
    before = asof_backward(heads, newest, "stamp_us", ["event_id", "_s", *more], width=width).filter("_s <= lower")
    return before.select("sweep_id", "event_id", F.col("_s").alias("stamp_us"), *more)


def sweep_imu(sweeps: DataFrame, imu: DataFrame, width: int) -> DataFrame:
    """(sweep_id, event_id, stamp_us, straddler): samples in (lower, t_end], and the newest at or before t_begin if it isn't after lower.

    lower is the least of the previous sweep's end and the sweep's own start.
    """
    bounded = _bounded(sweeps, width)
    inside = interval_join(bounded, imu, "lower", "t_end", "stamp_us", width, open_low=True).select("sweep_id", "event_id", "stamp_us", F.lit(False).alias("straddler"))
    return inside.unionByName(_straddlers(bounded, imu, width, []).withColumn("straddler", F.lit(True)))


def sweep_imu_sums(sweeps: DataFrame, imu: DataFrame, width: int) -> DataFrame:
    """(sweep_id, n_imu, straddler_stamp, mean_value) of the rows of sweep_imu, without making them.

    A sweep's samples are the rest of lower's bucket, whole buckets, and the beginning of t_end's: running sums of a
    bucket from both sides, nothing is subtracted. Only sweeps within one bucket meet their samples one by one.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    bounded = _bounded(sweeps, width).withColumn("_b", bucket("lower")).withColumn("_e", bucket("t_end"))
    samples = imu.select("stamp_us", F.col("value").cast("double").alias("value")).filter("stamp_us is not null").withColumn("_b", bucket("stamp_us"))
    sums = {"n": F.count(F.lit(1)), "k": F.count("value"), "s": F.sum("value")}
    up, down = Window.partitionBy("_b").orderBy("stamp_us"), Window.partitionBy("_b").orderBy(F.desc("stamp_us"))
    # peers share their sums, since the frames are ranges
    marks = samples.select("stamp_us", F.col("stamp_us").alias("_s"), *[f.over(up).alias(f"u_{c}") for c, f in sums.items()], *[f.over(down).alias(f"d_{c}") for c, f in sums.items()])
    long = bounded.filter("_b < _e")
    rest = asof_forward(long.select("sweep_id", "_b", F.col("lower").alias("stamp_us")), marks, "stamp_us", ["_s", "d_n", "d_k", "d_s"], strict=True, width=width).filter(bucket("_s") == F.col("_b"))
    start = asof_backward(long.select("sweep_id", "_e", F.col("t_end").alias("stamp_us")), marks, "stamp_us", ["_s", "u_n", "u_k", "u_s"], width=width).filter(bucket("_s") == F.col("_e"))
    whole = long.filter("_b + 1 < _e").select("sweep_id", F.explode(F.sequence(F.col("_b") + 1, F.col("_e") - 1)).alias("_b")).join(samples.groupBy("_b").agg(*[f.alias(c) for c, f in sums.items()]), "_b")
    short = interval_join(bounded.filter("_b = _e").drop("_b", "_e"), samples.drop("_b"), "lower", "t_end", "stamp_us", width, open_low=True)
    none, one = F.lit(None).cast(bounded.schema["t_begin"].dataType), [F.lit(1).cast("long").alias("n"), F.col("value").isNotNull().cast("long").alias("k"), F.col("value").cast("double").alias("s")]
    parts = [
        rest.select("sweep_id", *[F.col(f"d_{c}").alias(c) for c in sums], none.alias("straddler_stamp")), start.select("sweep_id", *[F.col(f"u_{c}").alias(c) for c in sums], none.alias("straddler_stamp")),
        whole.select("sweep_id", *sums, none.alias("straddler_stamp")), short.select("sweep_id", *one, none.alias("straddler_stamp")),
    ]
    found = _straddlers(bounded, imu, width, ["value"]).select("sweep_id", *one, F.col("stamp_us").alias("straddler_stamp"))
    for part in parts:
        found = found.unionByName(part)
    return found.groupBy("sweep_id").agg(F.sum("n").alias("n_imu"), F.max("straddler_stamp").alias("straddler_stamp"), F.when(F.sum("k") > 0, F.sum("s") / F.sum("k")).alias("mean_value"))


def assigned_once(sweeps: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Each event goes to the earliest sweep [t_begin, t_end] that holds it: (event_id, stamp_us, sweep_id).

    A sweep that ends no later than an earlier one never gets an event, so only sweeps that end later than all before them
    count. Their ends ascend: an event's sweep is the first that ends at or after it, if that has begun. No pairs are made.
    """
    rows = sweeps.select("t_begin", "t_end", "sweep_id").filter("t_begin is not null and t_end is not null").withColumn("_bucket", F.floor(F.col("t_begin") / width))
    order = [Window.partitionBy("_bucket").orderBy("t_begin", "sweep_id"), Window.orderBy("_bucket")]
    own, before = (F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c, w in zip(("t_end", "_last"), order, strict=True))
    # one row a bucket
    ends = rows.groupBy("_bucket").agg(F.max("t_end").alias("_last")).withColumn("_before", before).drop("_last")
    first = rows.withColumn("_own", own).join(ends, "_bucket").filter("t_end > coalesce(greatest(_own, _before), t_end - 1)")
    holders = first.select(F.col("t_end").alias("stamp_us"), F.col("t_begin").alias("_begin"), "sweep_id")
    found = asof_forward(events.select("event_id", "stamp_us").filter("stamp_us is not null").distinct(), holders, "stamp_us", ["_begin", "sweep_id"], width=width)
    return found.filter("_begin <= stamp_us").select("event_id", "stamp_us", "sweep_id")


def sweep_image(sweeps: DataFrame, images: DataFrame, width: int) -> DataFrame:
    """(sweep_id, image_id): of the images that a sweep consumes, the first."""
    return assigned_once(sweeps, images, width).groupBy("sweep_id").agg(F.min_by("event_id", F.struct("stamp_us", "event_id")).alias("image_id"))


def measure_group(sweeps: DataFrame, imu: DataFrame, images: DataFrame, fixes: DataFrame, width: int) -> DataFrame:
    """One row per sweep: n_imu, straddler_stamp, image_id, n_gnss and the mean of its samples' values."""
    own = sweep_imu_sums(sweeps, imu, width)
    gnss = assigned_once(sweeps, fixes, width).groupBy("sweep_id").agg(F.count(F.lit(1)).alias("n_gnss"))
    joined = sweeps.select("sweep_id").join(own, "sweep_id", "left").join(sweep_image(sweeps, images, width), "sweep_id", "left").join(gnss, "sweep_id", "left")
    return joined.select("sweep_id", F.coalesce("n_imu", F.lit(0)).alias("n_imu"), "straddler_stamp", "image_id", F.coalesce("n_gnss", F.lit(0)).alias("n_gnss"), "mean_value")


def cells(df: DataFrame, edge: float, axes: str = "xyz") -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / edge).cast("long") for a in axes})


def _around(axes: str):
    """The steps to a cell's neighbours, with their places in the probe order (first axis outermost)."""
    return F.array(*[F.struct(F.lit(i).alias("probe"), *[F.lit(s).alias(f"d{a}") for a, s in zip(axes, o, strict=True)]) for i, o in enumerate(_product([-1, 0, 1], len(axes)))])


def probes(df: DataFrame, axes: str = "xyz") -> DataFrame:
    """One row for each of the neighbouring cells, with its place in the probe order (first axis outermost)."""
    out = df.withColumn("_p", F.explode(_around(axes)))
    return out.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"_p.d{a}") for a in axes}).withColumn("probe", F.col("_p.probe")).drop("_p")


def _product(steps: list[int], n: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(n):
        out = [o + (s,) for o in out for s in steps]
    return out


def _looked_into(queries: DataFrame, targets: DataFrame, axes: str, by: tuple[str, ...], reach: float | None) -> DataFrame:
    """One row for each query and cell around that holds a target and whose targets' bounding box lies within ``reach`` of it; both sides have their cells.

    Cells are matched with cells first, so a query goes once to its own cell, and only what it reaches is made of it. A box's distance
    is worked out like a pair's, step by step, so rounding can't make it the larger one.
    """
    keys = [*by, *(f"c{a}" for a in axes)]
    ends = {f"_{n}{a}": f(F.when(~F.isnan(a), F.col(a))) for a in axes for n, f in (("l", F.min), ("h", F.max))}
    boxes = targets.groupBy(*keys).agg(*[v.alias(k) for k, v in ends.items()]).withColumn("_p", F.explode(_around(axes)))
    box = F.struct(F.col("_p.probe").alias("probe"), *[f"c{a}" for a in axes], *ends)
    seen = boxes.select(*by, *[(F.col(f"c{a}") - F.col(f"_p.d{a}")).alias(f"c{a}") for a in axes], box.alias("_b")).groupBy(*keys).agg(F.collect_list("_b").alias("_boxes"))

    def near(b):
        gaps = [F.greatest(b[f"_l{a}"] - F.col(a), F.col(a) - b[f"_h{a}"], F.lit(0.0)) for a in axes]
        return sum((g * g for g in gaps), F.lit(0.0)) <= reach**2

    found = queries.join(seen, keys).withColumn("_b", F.explode("_boxes" if reach is None else F.filter("_boxes", near)))
    return found.withColumns({f"c{a}": F.col(f"_b.c{a}") for a in axes}).withColumn("probe", F.col("_b.probe")).drop("_b", "_boxes")


def grid_pairs(queries: DataFrame, targets: DataFrame, edge: float, axes: str = "xyz", apart: str | None = None, by: tuple[str, ...] = (), keep: bool = False, also: tuple[str, ...] = (), reach: float | None = None) -> DataFrame:
    """Queries (q, axes) with targets (id, axes) of the 27 cells around; d2 is the squared distance.

    Cells that hold no target are dropped before the equi-join, so that the probes don't blow it up; with ``reach`` those too
    whose targets all lie farther from the query, so pairs within it are complete. With
    ``apart`` pairs that agree in that column (of a scan, say) are left out; with ``by`` only those that agree in
    these columns are made. With ``keep`` the target's place comes along as t and its axis, with ``also`` columns of the query.
    """
    more = [*by, *([apart] if apart else [])]
    t = cells(targets.select("id", *more, *axes), edge, axes)
    keys = [*by, *(f"c{a}" for a in axes)]
    near = _looked_into(cells(queries.select("q", *more, *axes, *also), edge, axes), t, axes, by, reach)
    # both sides grow with the table
    pairs = near.join(t.withColumnsRenamed({a: f"t{a}" for a in [*([apart] if apart else []), *axes]}).hint("merge"), keys)
    if apart:
        pairs = pairs.filter(F.col(apart) != F.col(f"t{apart}"))
    d2 = sum(((F.col(a) - F.col(f"t{a}")) * (F.col(a) - F.col(f"t{a}")) for a in axes), F.lit(0.0))
    return pairs.select(*by, "q", "id", "probe", d2.alias("d2"), *([f"t{a}" for a in axes] if keep else []), *also)


#: The part of an edge within which the nearest target is looked for first.
FINE = 1 / 8


#: Numbers that places are dealt by.
SLOTS = 1 << 20


def voxel_nn(queries: DataFrame, targets: DataFrame | None, edge: float, max_distance: float, axes: str = "xyz", apart: str | None = None, whole: bool = False) -> DataFrame:
    """(q, id, d2): the nearest target of the cells around within max_distance; ties go by probe order, then id.

    Without targets the queries are matched with one another, which takes ``apart``. With ``whole`` all queries come back, with apart and
    axes, and null where nothing is near. Targets in one place count as two at most, the least id and the least that differs from it in ``apart``,
    and a query that lies on one is done without a search: queries and targets are dealt by their places once. Others look into small cells first,
    and only those that find nothing there into whole ones; so dense clouds make no pairs by the square of their density.
    """
    cols = [*([apart] if apart else []), *axes]
    usable = F.lit(True)
    for a in axes:
        usable = usable & (F.abs(F.col(a)) < float("inf")) & ~F.isnan(a)
    if apart:
        usable = usable & F.col(apart).isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    named = ["q"] if targets is None else ["q", "id"]
    rows = queries.select("q", *cols) if targets is None else queries.select("q", *cols).unionByName(targets.select("id", *cols).filter(usable), allowMissingColumns=True)
    if not whole:
        rows = rows.filter(usable)
    ident = F.col(named[-1])
    asks, stands = F.col("q").isNotNull(), ident.isNotNull() & usable
    # zeros of both signs are one place
    slot = F.pmod(F.xxhash64(*[F.col(a) + F.lit(0.0) for a in axes]), F.lit(SLOTS))
    place = Window.partitionBy("_slot", *axes)
    one = F.struct(ident.alias("id"), *cols[: -len(axes)])
    marked = rows.withColumn("_slot", slot).repartition("_slot").withColumn("_first", F.min(F.when(stands, one)).over(place))
    on, second = F.col("_first.id"), F.lit(None)
    if apart:
        marked = marked.withColumn("_second", F.min(F.when(stands & (F.col(apart) != F.col(f"_first.{apart}")), one)).over(place))
        second = F.col("_second.id")
        on = F.when(F.col(f"_first.{apart}") != F.col(apart), on).otherwise(second)
    two = stands & F.coalesce((ident == F.col("_first.id")) | (ident == second), F.lit(False))
    # of queries that are done nothing else is needed
    kept = [F.when(F.lit(whole) | F.col("_two") | F.col("_on").isNull(), F.col(c)).alias(c) for c in cols]
    marked = marked.withColumn("_two", two).withColumn("_on", F.when(usable, on))
    marked = settle(marked.select(*named, *kept, "_on", "_two"))
    out = ["q", *(cols if whole else ()), "id", "d2"]
    asking, stood = marked.filter(asks), marked.filter("_two").select(ident.alias("id"), *cols)
    own, kind = asking.select("q", *cols, F.col("_on").alias("id")), marked.schema["_on"].dataType
    found = [own.filter("id is not null").withColumn("d2", F.lit(0.0)).select(*out)]
    rest = own.filter("id is null").drop("id")
    if whole:
        found.append(rest.filter(~usable).withColumn("id", F.lit(None).cast(kind)).withColumn("d2", F.lit(None).cast("double")).select(*out))
        rest = rest.filter(usable)
    fine = edge * FINE
    if fine < max_distance:
        # a little less than the cells' edge, so that rounding of a cell's number hides none
        best = _nearest(rest, stood, fine, 0.99 * fine, edge, axes, apart)
        rest = settle(rest.join(best.hint("merge"), "q", "left"))
        found.append(rest.filter("id is not null").select(*out))
        rest = rest.filter("id is null").drop("id", "d2")
    best = _nearest(rest, stood, edge, max_distance, edge, axes, apart)
    found.append(rest.join(best.hint("merge"), "q", "left").select(*out) if whole else best)
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _nearest(queries: DataFrame, targets: DataFrame, width: float, most: float, edge: float, axes: str, apart: str | None) -> DataFrame:
    """(q, id, d2) of the nearest within ``most`` in the cells of ``width`` around; ties by where the target's cell of ``edge`` lies, then id."""
    side = lambda c, a: F.floor(F.col(c) / edge).cast("long").alias(f"_{a}")
    q = queries.withColumn("_at", F.struct(*[side(a, a) for a in axes]))
    near = grid_pairs(q, targets, width, axes, apart, keep=True, also=("_at",), reach=most).filter(F.col("d2") <= most**2)
    probe = F.lit(0)
    for a in axes:
        probe = probe * 3 + F.floor(F.col(f"t{a}") / edge).cast("long") - F.col(f"_at._{a}") + 1
    best = near.groupBy("q").agg(F.min(F.struct("d2", probe.alias("probe"), "id")).alias("b"))
    return best.select("q", F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))


def voxel_radius(queries: DataFrame, targets: DataFrame, edge: float, radius: float, axes: str = "xyz", apart: str | None = None) -> DataFrame:
    """(q, id, d2): all targets of the cells around within the radius; complete for radius <= edge."""
    return grid_pairs(queries, targets, edge, axes, apart, reach=radius).filter(F.col("d2") <= radius**2).select("q", "id", "d2")


def plane_lookup(queries: DataFrame, planes: DataFrame) -> DataFrame:
    """(q, plane, rms): the plane of a query's own cell, else that with the least rms of the cells around. Both sides have cx, cy, cz."""
    keys = ["cx", "cy", "cz"]
    own = queries.join(planes, keys).select("q", "plane", "rms")
    rest = queries.join(planes, keys, "left_anti")
    near = probes(rest).join(planes, keys).groupBy("q").agg(F.min(F.struct("rms", "plane")).alias("b")).select("q", F.col("b.plane").alias("plane"), F.col("b.rms").alias("rms"))
    return own.unionByName(near)


def revisit_candidates(poses: DataFrame, min_gap: int, min_time: int, max_xy: float, by: list[str]) -> DataFrame:
    """(q, id): earlier poses of the run that lie near in the plane, at least min_gap numbers and min_time away; a missing stamp or place passes."""
    a = poses.select(*by, F.col("n").alias("q"), F.col("t").alias("qt"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    b = poses.select(*by, F.col("n").alias("id"), "t", "x", "y")
    placed = [F.col("qx").isNotNull() & F.col("qy").isNotNull(), F.col("x").isNotNull() & F.col("y").isNotNull()]
    cell = lambda x, y: (F.floor(x / max_xy), F.floor(y / max_xy))
    ca, cb = cell(F.col("qx"), F.col("qy")), cell(F.col("x"), F.col("y"))
    left = a.filter(placed[0]).withColumn("_x", ca[0]).withColumn("_y", ca[1])
    around = b.filter(placed[1]).withColumn("_x", F.explode(F.array(cb[0] - 1, cb[0], cb[0] + 1))).withColumn("_y", F.explode(F.array(cb[1] - 1, cb[1], cb[1] + 1)))
    # sizes estimated before the explode would have one side broadcast, ninefold; both sides grow with the table
    near = left.join(around.hint("merge"), [*by, "_x", "_y"]).filter((F.pow(F.col("qx") - F.col("x"), F.lit(2.0)) + F.pow(F.col("qy") - F.col("y"), F.lit(2.0))) <= max_xy**2)
    # rows without a place meet all others of their run; there are few, and only they
    unplaced = a.join(b.filter(~placed[1]).hint("merge"), by).unionByName(a.filter(~placed[0]).join(b.filter(placed[1]).hint("merge"), by))
    keep = (F.col("id") < F.col("q")) & (F.col("q") - F.col("id") >= min_gap) & (F.col("t").isNull() | F.col("qt").isNull() | (F.col("qt") - F.col("t") >= min_time))
    cols = [*by, "q", "id"]
    return near.filter(keep).select(*cols).unionByName(unplaced.filter(keep).select(*cols))


def region_join(boxes: DataFrame, regions: DataFrame, axes: str = "xy") -> DataFrame:
    """(region, id): boxes that meet a region; regions are few, fixed queries and are broadcast."""
    meets = " and ".join(f"min_{a} <= r_max_{a} and max_{a} >= r_min_{a}" for a in axes)
    return boxes.join(F.broadcast(regions), F.expr(meets)).select("region", "id")


def radius_join(poses: DataFrame, centre: tuple[float, ...], radius: float, axes: str = "xy") -> DataFrame:
    d2 = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip(axes, centre, strict=True)), F.lit(0.0))
    return poses.filter(d2 <= radius**2)


def extrinsic_lookup(samples: DataFrame, extrinsics: DataFrame, keep_missing: bool) -> DataFrame:
    """Each sample with its sensor's transform: missing ones are identity (keep_missing) or dropped. The dimension is broadcast."""
    out = samples.join(F.broadcast(extrinsics), "sensor_id", "left" if keep_missing else "inner")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("tx", "ty", "tz")}) if keep_missing else out


def not_yet_mapped(stored: DataFrame, mapped: DataFrame, placed: DataFrame) -> DataFrame:
    return stored.join(mapped, "id", "left_anti").join(placed, "id", "left_semi")


def positional_zip(a: DataFrame, b: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of equal rank in both; columns that aren't keys get a_ and b_ before their names. Unequal lengths leave nulls."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    left, right = a.withColumn("rank", rank), b.withColumn("rank", rank)
    names = [*by, "rank"]
    left = left.select(*names, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in by])
    right = right.select(*names, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in by])
    return left.join(right, names, "full_outer")


def cube_corners(voxels: DataFrame) -> DataFrame:
    """(cx, cy, cz, values) of cells whose eight corners are all observed; voxels are (cx, cy, cz, value), values ordered by corner."""
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for i, (x, y, z) in enumerate((x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1))])
    # a voxel is a corner of eight cells, so one shuffle of its copies is enough
    of = voxels.withColumn("c", F.explode(corners)).select(F.expr("cx - c.dx").alias("cx"), F.expr("cy - c.dy").alias("cy"), F.expr("cz - c.dz").alias("cz"), F.col("c.corner").alias("corner"), "value")
    full = of.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("corner", "value"))).alias("v")).filter("n = 8")
    return full.select("cx", "cy", "cz", F.transform("v", lambda s: s["value"]).alias("values"))


def occlusion_march(rays: DataFrame, solid: DataFrame, edge: float) -> DataFrame:
    """Rays (ray, ox, oy, oz, dx, dy, dz unit, len) that pass a solid voxel (cx, cy, cz) from one voxel out to 1.5 voxels before the end, in half steps."""
    steps = F.sequence(F.lit(0), F.floor((F.col("len") - 2.5 * edge) / (0.5 * edge)).cast("int"))
    at = rays.filter(F.col("len") >= 2.5 * edge).withColumn("s", F.explode(steps)).withColumn("d", edge + F.col("s") * 0.5 * edge)
    at = at.select("ray", *[F.floor((F.col(f"o{a}") + F.col(f"d{a}") * F.col("d")) / edge).cast("long").alias(f"c{a}") for a in "xyz"])
    return at.join(solid.select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi").select("ray").distinct()


def moved_windows(windows: DataFrame, moved: DataFrame) -> DataFrame:
    """Windows (anchor, ids) that hold a moved id."""
    return windows.withColumn("id", F.explode("ids")).join(moved, "id", "left_semi").select("anchor").distinct()
