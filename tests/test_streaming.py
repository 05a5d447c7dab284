"""Alignment as a stream: batches, timers, the end of a stream, and the size of what is held."""

import random

from posegrid.streaming import align

ROW = "rig long, modality string, stamp_us long, event_id long"


def brute(rows, sweep, rigs):
    """Groups of complete streams, by definition."""
    out = set()
    for rig in rigs:
        own = sorted((s, e, m) for r, m, s, e in rows if r == rig)
        prev, used = None, set()
        newest = max((s for s, _, m in own if m == "imu"), default=None)
        for b, sid, m in own:
            if m != "lidar":
                continue
            e = b + sweep
            lower = b if prev is None else min(prev, b)
            imu = [s for s, _, k in own if k == "imu"]
            before = [s for s in imu if s <= b]
            straddler = before[-1] if before and before[-1] <= lower else None
            inside = sum(lower < s <= e for s in imu)
            images = [i for s, i, k in own if k == "camera" and b <= s <= e and i not in used]
            fixes = [i for s, i, k in own if k == "gnss" and b <= s <= e and i not in used]
            used |= set(images) | set(fixes)
            out.add((rig, sid, inside + (straddler is not None), straddler, images[0] if images else None, len(fixes), newest is None or newest < e))
            prev = e
    return out


def made(rng, n, rigs, span):
    rows, kinds = [], ["imu"] * 10 + ["camera", "gnss", "lidar"]
    for i in range(n):
        rows.append((rng.choice(rigs), rng.choice(kinds), rng.randrange(span), i))
    return sorted(rows, key=lambda r: r[2])


def run(spark, tmp_path, files, rules):
    """Each list of rows is one micro-batch."""
    import time

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with align.keyed_state(spark):
        query = align.fan_out(align.align(source, rules), f"{tmp_path}/cp", [align.parquet_sink(f"{tmp_path}/out")])
    query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(align.OUT).parquet(f"{tmp_path}/out").collect()]


def test_batches_and_drain_give_the_groups_of_the_whole_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = made(rng, 600, [1, 2, 3], 20_000_000)
    late = [r for r in rows if r[2] > 0]
    parts = [late[i : i + 150] for i in range(0, len(late), 150)]
    rules = align.Rules(400_000, 100_000, 10**9, (), 10**9)
    got = run(spark, tmp_path, [*parts, [(r, align.END, 20_000_000, -1) for r in (1, 2, 3)]], rules)
    assert {r[:7] for r in got} == brute(rows, 400_000, [1, 2, 3]) and len(got) == len({r[1] for r in got})
    assert all(r[7] == 0 for r in got)


def test_timers_close_what_waits_and_drop_silent_rigs(spark, tmp_path):
    s = 1_000_000
    first = [(1, "imu", 10 * s, 1), (1, "lidar", 10 * s, 2), (1, "camera", 10 * s + 1000, 3), (2, "imu", 10 * s, 4), (2, "lidar", 10 * s, 5)]
    # only rig 2 goes on; the stream's time passes the wait of rig 1's sweep, and then its patience
    second, third, fourth = [(2, "imu", 11 * s, 6)], [(2, "imu", 12 * s, 7)], [(2, "imu", 90 * s, 8)]
    more = [(1, "lidar", 91 * s, 9), (1, "imu", 92 * s, 10), (2, "imu", 93 * s, 11)]
    rules = align.Rules(100_000, 20_000, 500_000, (), 30 * s)
    got = sorted(run(spark, tmp_path, [first, second, third, fourth, [(2, "imu", 90 * s + 5, 12)], more], rules), key=lambda r: r[1])
    assert [(r[0], r[1], r[6]) for r in got] == [(1, 2, True), (2, 5, False), (1, 9, False)]
    assert got[0][4] == 3 and got[0][2] == 1
    # the state was dropped in between: the straddler of the later sweep isn't the sample of long ago
    assert got[2][3] is None


def test_state_stays_small():
    rng = random.Random(3)
    rules = align.Rules(100_000, 20_000, 150_000, (), 10**9)
    state, most, closed = align.empty(), 0, 0
    for i in range(20_000):
        t = 5000 * i + rng.randrange(4000)
        align.push(state, "lidar" if i % 20 == 0 else "camera" if i % 7 == 0 else "gnss" if i % 11 == 0 else "imu", t, i, rules)
        closed += len(align.close(state, rules, 1))
        most = max(most, sum(map(len, state["staged"].values())))
    assert closed > 990 and most < 120
    capped = align.Rules(100_000, 20_000, 150_000)
    state = align.empty()
    for i in range(100):
        align.push(state, "camera", i, i, capped)
    assert len(state["staged"]["camera"]) == 16 and state["dropped"] == 84


def test_feedback_gives_the_same_versions_when_batches_run_again(spark, tmp_path):
    """Two folders, one with a failure after the sink's write; both end with the same versions and rows."""
    from posegrid.streaming import feedback
    from pyspark.sql import functions as F

    for k in range(4):
        spark.createDataFrame([(run, float(k * 10 + i)) for run in (1, 2) for i in range(k + 1) if run < 2 or k % 2], "run long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        __import__("time").sleep(0.05)

    def go(name, fail_at):
        table = feedback.Corrections(spark, f"{tmp_path}/{name}/c", "run long, cx double", ["run"])
        failed = []

        def sink(batch, number):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/{name}/out/batch={number}")
            if number == fail_at and not failed:
                failed.append(number)
                raise RuntimeError("lost")

        def start():
            stream = spark.readStream.schema("run long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            return feedback.with_feedback(
                stream, f"{tmp_path}/{name}/cp", table, lambda b, c: b.join(c, "run", "left").select("run", (F.col("x") + F.coalesce("cx", F.lit(0.0))).alias("x")), lambda d, c: d.groupBy("run").agg(F.max("x").alias("cx")), sink
            )

        try:
            start().awaitTermination()
        except Exception as e:
            assert fail_at is not None and "lost" in str(e)
            start().awaitTermination()
        versions = [sorted(map(tuple, table.as_of(v).collect())) for v in range(-1, 4)]
        return versions, sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/out").collect()))

    plain, again = go("a", None), go("b", 2)
    assert plain == again
    assert plain[0] == [[], [(1, 0.0)], [(1, 11.0), (2, 11.0)], [(1, 33.0), (2, 11.0)], [(1, 66.0), (2, 44.0)]]
