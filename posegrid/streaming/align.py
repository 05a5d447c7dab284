"""Structured Streaming forms: alignment of streams into groups, throttles, sinks.

Spark's watermark is one for all inputs of a query; groups here close by the progress of each modality, or
after a wait, so the state keeps its own high-water marks for each key (a vehicle or rig), and timers for what waits.
"""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MODALITIES = ("imu", "camera", "gnss", "lidar")
#: Rows of this modality say that a rig's stream has ended: all that it holds is given out. Their stamp must not be older than the watermark, as that of any row.
END = "end"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query is started, its state store is RocksDB, which list states and timers need; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


@dataclass(frozen=True)
class Rules:
    """``caps`` bounds what is staged of a modality (the oldest goes, and is counted); ``idle_us`` is how long a silent rig's state is kept."""

    sweep_us: int = 100_000
    reorder_us: int = 20_000
    max_wait_us: int = 150_000
    caps: tuple[tuple[str, int], ...] = (("imu", 8192), ("camera", 16), ("gnss", 64), ("lidar", 8))
    idle_us: int = 60_000_000


OUT = "rig long, sweep_id long, n_imu long, straddler_stamp long, image_id long, n_gnss long, late boolean, dropped long"


def empty() -> dict:
    return {"staged": {m: [] for m in MODALITIES}, "marks": {}, "prev_end": None, "dropped": 0}


def push(state: dict, modality: str, stamp: int, event: int, rules: Rules) -> None:
    """Stage a sample in order; one later than the reordering window is dropped and counted, as is the oldest beyond a cap."""
    mark = state["marks"].get(modality)
    if mark is not None and stamp < mark - rules.reorder_us:
        state["dropped"] += 1
        return
    state["marks"][modality] = stamp if mark is None else max(mark, stamp)
    rows = state["staged"][modality]
    bisect.insort(rows, (stamp, event))
    cap = dict(rules.caps).get(modality)
    if cap is not None and len(rows) > cap:
        del rows[0]
        state["dropped"] += 1


def close(state: dict, rules: Rules, rig: int, final: bool = False, now: int | None = None) -> list[tuple]:
    """Groups whose head sweep is covered by the inertial stream, or has waited long enough; strictly in order of sweeps.

    ``now`` is a time that the whole stream has reached, if that is later than the rig's own. What no later sweep can
    need is let go: samples before the newest one that is older than the sweep by the reordering window, images and fixes
    up to its end.
    """
    out = []
    staged, marks = state["staged"], state["marks"]
    reached = max([*marks.values(), *([now] if now is not None else [])], default=0)
    taken = 0
    for begin, sweep in staged["lidar"]:
        end = begin + rules.sweep_us
        newest = marks.get("imu")
        covered = newest is not None and newest >= end
        if not (covered or reached - end >= rules.max_wait_us or final):
            break
        taken += 1
        imu = staged["imu"]
        lower = begin if state["prev_end"] is None else min(state["prev_end"], begin)
        upto = bisect.bisect_right(imu, (begin, float("inf")))
        straddler = imu[upto - 1][0] if upto and imu[upto - 1][0] <= lower else None
        inside = bisect.bisect_right(imu, (end, float("inf"))) - bisect.bisect_right(imu, (lower, float("inf")))
        found = {}
        for m in ("camera", "gnss"):
            rows = staged[m]
            first, last = bisect.bisect_left(rows, (begin,)), bisect.bisect_right(rows, (end, float("inf")))
            found[m] = (rows[first][1] if first < last else None, last - first)
            del rows[:last]
        out.append((rig, sweep, inside + (straddler is not None), straddler, found["camera"][0], found["gnss"][1], not covered, state["dropped"]))
        state["prev_end"], state["dropped"] = end, 0
        old = bisect.bisect_right(imu, (begin - rules.reorder_us, float("inf")))
        if old:
            del imu[: bisect.bisect_left(imu, (imu[old - 1][0],))]
    del staged["lidar"][:taken]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"straddler_stamp": "Int64", "image_id": "Int64"})


class Aligner(StatefulProcessor):
    """One rig's staging: a list state for each modality, its marks, and timers in event time for sweeps that wait and rigs that fall silent."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = {m: handle.getListState(m, "stamp long, event long") for m in MODALITIES}
        self.marks = handle.getValueState("marks", ", ".join(f"{m} long" for m in MODALITIES) + ", prev_end long, dropped long")

    def _load(self) -> dict:
        state = empty()
        if self.marks.exists():
            *marks, state["prev_end"], state["dropped"] = self.marks.get()
            state["marks"] = {m: v for m, v in zip(MODALITIES, marks, strict=True) if v is not None}
        for m, held in self.lists.items():
            state["staged"][m] = [tuple(r) for r in held.get()] if held.exists() else []
        return state

    def _keep(self, state: dict) -> None:
        for m, held in self.lists.items():
            held.put(state["staged"][m]) if state["staged"][m] else held.clear()
        self.marks.update((*(state["marks"].get(m) for m in MODALITIES), state["prev_end"], state["dropped"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = max(state["marks"].values(), default=None)
        if newest is not None:
            due = [newest + self.rules.idle_us] + [s + self.rules.sweep_us + self.rules.max_wait_us for s, _ in state["staged"]["lidar"][:1]]
            self.handle.registerTimer(min(due) // 1000 + 1)

    def _end(self) -> None:
        for held in self.lists.values():
            held.clear()
        self.marks.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, final = self._load(), False
        batch = pd.concat(list(rows)).sort_values(["stamp_us", "event_id"])
        for m, s, e in zip(batch["modality"].tolist(), batch["stamp_us"].tolist(), batch["event_id"].tolist(), strict=True):
            if m == END:
                final = True
            elif m in state["staged"]:
                push(state, m, s, e, self.rules)
        out = close(state, self.rules, int(key[0]), final)
        self._end() if final else self._keep(state)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = self._load(), expiredTimerInfo.getExpiryTimeInMs() * 1000
        silent = now - max(state["marks"].values(), default=0) >= self.rules.idle_us
        out = close(state, self.rules, int(key[0]), silent, now)
        self._end() if silent else self._keep(state)
        yield _frame(out)

    def close(self) -> None:
        pass


def align(samples: DataFrame, rules: Rules = Rules(), delay: str = "0 seconds") -> DataFrame:
    """Measure groups of a stream (rig, modality, stamp_us, event_id): one row for each sweep as it closes.

    A sweep closes once its rig's inertial samples cover it, once the rig or the stream's watermark (``delay`` behind the
    newest stamp) is ``max_wait_us`` past its end, when a row of modality ``END`` comes, or when the rig has been silent for
    ``idle_us``; the last two give out all that is held and drop the state. Queries are started within :func:`keyed_state`.
    """
    stamped = samples.withColumn("at", F.timestamp_micros("stamp_us")).withWatermark("at", delay)
    return stamped.groupBy("rig").transformWithStateInPandas(Aligner(rules), OUT, "Append", "EventTime")


def throttle(samples: DataFrame, interval_us: int) -> DataFrame:
    """Rows (key, stamp_us, event_id) of a stream at least ``interval_us`` after the last one of their key that was let through."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["stamp_us", "event_id"])
        for s, e in zip(rows["stamp_us"].tolist(), rows["event_id"].tolist(), strict=True):
            if last is None or s - last >= interval_us:
                out.append((key[0], s, e))
                last = s
        if last is not None:
            held.update((last,))
        yield pd.DataFrame(out, columns=["key", "stamp_us", "event_id"])

    return samples.groupBy("key").applyInPandasWithState(step, "key string, stamp_us long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, checkpoint: str, sinks: list[Callable[[DataFrame, int], None]], **trigger) -> StreamingQuery:
    """Write each micro-batch to several sinks; the batch is computed once. Sinks get (batch, batch id), so that they can be idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder for each batch, so that a batch that is run again replaces what it wrote before."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def null_sink() -> Callable[[DataFrame, int], None]:
    return lambda batch, number: batch.write.format("noop").mode("overwrite").save()
