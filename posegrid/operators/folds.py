"""Ordered folds per key: for what depends on the last emitted row, where plain windows are wrong."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together in one partition, sorted by key and order, for a pass over partitions.

    A repartition by the keys alone is dropped where the input is joined by them, and Spark may then read that join's
    shuffle by its writers or in pieces, which parts a key's rows. A hash of the keys is dealt out in any case.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def streamed_fold(df: DataFrame, keys: list[str], order: list[str], init: dict, step: Callable[[dict, dict], dict], keep: list[str], state: str, emit: str | None = None) -> DataFrame:
    """One row for each row of ``df``: keys, ``keep`` and the state after it; a fold over each key's rows in order.

    Partitions are sorted by key and order and passed through once with the state of one key, so time is
    linear and memory doesn't grow with a key's rows. ``init`` is the state before the first row, ``step`` gives
    the next one from (state, row). ``state`` is the state's schema as DDL ("a double, n long"). With ``emit``
    only rows whose state holds true under that name are returned.
    """
    names = [x.split()[0] for x in state.split(",")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, *keep).schema)
    target = df.sparkSession.createDataFrame([], f"{kinds}, {state}").schema
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now = None, init
        for batch in batches:
            columns = batch.to_pydict()
            rows = zip(*columns.values(), strict=True)
            taken, states = [], []
            for i, (key, row) in enumerate(zip(zip(*(columns[k] for k in keys), strict=True), rows, strict=True)):
                if key != here:
                    here, now = key, init
                now = step(now, dict(zip(columns, row, strict=True)))
                if emit is None or now[emit]:
                    taken.append(i)
                    states.append([now[n] for n in names])
            if taken:
                kept = batch.take(pa.array(taken, pa.int64()))
                made = zip(*states, strict=True)
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in [*keys, *keep]] + [pa.array(v, arrow.field(n).type) for n, v in zip(names, made, strict=True)], schema=arrow)

    return in_order(df, keys, order).mapInArrow(run, target)


def _bucket_carry(rows: DataFrame, keys: list[str], order: list[str], alpha: float) -> DataFrame:
    """(keys, _bucket, carry, after): the exponential average of ``_v`` before and after each bucket.

    Within a bucket the average is a weighted sum, which combines before the shuffle; only one row a bucket is folded in order.
    """
    w = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).desc() for c in order])
    ranked = rows.withColumn("_r", F.row_number().over(w) - 1)
    weight = F.pow(F.lit(1 - alpha), F.col("_r"))
    parts = ranked.groupBy(*keys, "_bucket").agg(F.pow(F.lit(1 - alpha), F.count(F.lit(1))).alias("a"), F.sum(alpha * weight * F.col("_v")).alias("b"), F.min_by("_v", F.struct(*order)).alias("first"))

    def step(s: dict, r: dict) -> dict:
        # the first bucket carries nothing, so that its first value stands as it is
        before = r["first"] if s["after"] is None else s["after"]
        return {"carry": s["after"], "after": r["a"] * before + r["b"]}

    return streamed_fold(parts, keys, ["_bucket"], {"carry": None, "after": None}, step, ["_bucket"], "carry double, after double")


def ewma(df: DataFrame, keys: list[str], order: list[str], value: Column, alpha: float, bucket: Column, keep: list[str], name: str) -> DataFrame:
    """keys, ``keep`` and ``name``: the exponential average of ``value`` after each row, seeded by the key's first value; a null leaves it.

    ``bucket`` must not descend in the order of a key's rows (a day, say): a bucket is all that one task holds in
    sequence, however long the key's stream is.
    """
    rows = df.withColumn("_v", value.cast("double")).withColumn("_bucket", bucket)
    carry = _bucket_carry(rows.filter("_v is not null"), keys, order, alpha)
    # rows before the first value of their bucket show what the buckets before left
    behind = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.select(*keys, "_bucket").distinct().join(carry, [*keys, "_bucket"], "left").withColumn("held", F.last("after", True).over(behind)).drop("after")

    def step(s: dict, r: dict) -> dict:
        if r["_v"] is None:
            return s
        before = r["carry"] if s[name] is None else s[name]
        return {name: r["_v"] if before is None else (1 - alpha) * before + alpha * r["_v"]}

    out = streamed_fold(rows.join(seen, [*keys, "_bucket"]), [*keys, "_bucket"], order, {name: None}, step, [*keep, "held"], f"{name} double")
    return out.select(*keys, *keep, F.coalesce(name, "held").alias(name))


def last_ewma(df: DataFrame, keys: list[str], order: list[str], value: Column, alpha: float, bucket: Column, name: str) -> DataFrame:
    """keys and ``name``: the exponential average of ``value`` after a key's last row; see ewma."""
    rows = df.withColumn("_v", value.cast("double")).withColumn("_bucket", bucket).filter("_v is not null")
    return _bucket_carry(rows, keys, order, alpha).groupBy(*keys).agg(F.max_by("after", "_bucket").alias(name))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[kind]


def fold_sql(view: str, key: str, order: str, init: dict[str, str], step: dict[str, str], keep: list[str], select: str) -> tuple[str, list[str]]:
    """The fold as a recursive CTE for DuckDB: in ``step``, f is the state before and b the row."""
    base = f"b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n_ FROM {view})"
    seed = ", ".join(f"{v} AS {k}" for k, v in init.items())
    first = f"z AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS n_, {', '.join(f'CAST(NULL AS BIGINT) AS {c}_' for c in keep) or '0 AS none_'}, {seed} FROM b)"
    rest = ", ".join(f"b.{c}" for c in keep) or "0"
    rec = f"f AS (SELECT * FROM z UNION ALL SELECT b.{key}, b.n_, {rest}, {', '.join(step[k] for k in init)} FROM f JOIN b ON b.{key} = f.{key} AND b.n_ = f.n_ + 1)"
    out = f"o AS (SELECT {key}, {', '.join([f'{c}_ AS {c}' for c in keep] + list(init))} FROM f WHERE n_ > 0)"
    return select, [base, first, rec, out]
