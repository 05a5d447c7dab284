"""Settings, YAML loops, images and the packet log against plain versions."""

import json
import random

import numpy as np
import pytest
from posegrid import settings
from posegrid.sources import codecs, packet_log
from pyspark.sql import functions as F


def plain_check(known):
    """Messages of broken rules, by the rules' own words."""
    out = []
    for message, sql in settings.rules().items():
        python = sql.replace("<>", "!=").replace(" OR ", " or ").replace(" AND ", " and ").replace(" IN ", " in ").replace(" = ", " == ")
        for n, v in known.items():
            python = python.replace(f"{{{n}}}", repr(v))
        python = python.replace("in ('global')", "in ('global',)")
        if not eval(python):  # noqa: S307
            out.append(message)
    return out


def test_settings_of_many_configurations(spark):
    rng = random.Random(4)
    texts, known = [None, "no json", "[]", "{}", '{"backend": 5}'], [dict(settings.SETTINGS)] * 5
    for _ in range(60):
        own, nested = dict(settings.SETTINGS), {}
        for n in rng.sample(list(settings.SETTINGS), 12):
            default = settings.SETTINGS[n]
            v = rng.random() < 0.5 if isinstance(default, bool) else rng.choice(["global", "ptp", "radtan", "odd"]) if isinstance(default, str) else rng.choice([-1, 0, 1, 3]) if isinstance(default, int) else rng.choice([-0.5, 0.0, 0.3, 1.0, 250.0])
            own[n] = v
            *path, last = n.split(".")
            here = nested
            for p in path:
                here = here.setdefault(p, {})
            here[last] = v
        assert settings.load(json.dumps(nested)) == own
        texts.append(json.dumps(nested))
        known.append(own)
    df = settings.resolved(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), "text")
    rows = df.select("id", "readable", settings.broken(df).alias("broken"), *[f"`{n}`" for n in settings.SETTINGS]).orderBy("id").collect()
    for r, own in zip(rows, known, strict=True):
        assert {n: r[n] for n in settings.SETTINGS} == own
        assert r.broken == plain_check(own)
    assert [r.readable for r in rows[:5]] == [False, False, False, True, True]
    assert plain_check(settings.SETTINGS) == [] and len(settings.rules()) > 85


@pytest.mark.parametrize("bad", ['{"nope": {}}', '{"place": {"other": 1}}', '{"place": {"sc_Nr": 2.5}}', '{"backend": {"imu": {"acc_noise": "x"}}}', '{"sensors": {"lidar": {"ptp": 1}}}'])
def test_unknown_settings_are_errors(bad):
    with pytest.raises(settings.ConfigError):
        settings.load(bad)


YAML = """# loops found by hand
loops:
  - from_id: 3
    to_id: 9   # the later one
    t: [1.0, -2.5e-1, 0]
    q: [0, 0, 0, 2]
    cov_diag: [1, 2, 3, 4, 5, 6]
  - {from_id: 4, to_id: 2, t: [0,0,1], q: [0,0,3,4], cov_diag: [1,1,1,1,1,1], fitness: 0.25, at_kf: 11, outlier: true}
  - from_id: 5
    to_id: 6
    t: [1, 2]
    q: [0, 0, 0, 1]
    cov_diag: [1, 1, 1, 1, 1, 1]
  - from_id: 7
    to_id: 8
    t: [1, 2, 3]
    q: [0, 0, 0, 1]
  - to_id: 8
    t: [1, 2, 3]
    q: [0, 0, 0, 1]
"""


def test_loops_of_yaml_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    rows = {(r.from_id, r.to_id): r for r in codecs.read_loops_yaml(spark, str(tmp_path)).collect()}
    a, b = rows[3, 9], rows[4, 2]
    assert (a.t, a.q, a.fitness, a.at_kf, a.outlier, a.problem) == ([1.0, -0.25, 0.0], [0, 0, 0, 1], 0.8, 9, False, None)
    assert np.array_equal(np.array(a.cov).reshape(6, 6), np.diag([1.0, 2, 3, 4, 5, 6]))
    assert (b.q, b.fitness, b.at_kf, b.outlier) == ([0, 0, 0.6, 0.8], 0.25, 11, True)
    assert rows[5, 6].problem == "t must have 3 entries" and rows[7, 8].problem == "no covariance" and rows[None, 8].problem == "no id"
    assert len(rows) == 5


def test_loop_items_are_parsed_once(spark, tmp_path):
    """Keys without a value, named twice, inside other names or with an open bracket; each item goes through the pattern of its keys once."""
    items = [
        "{from_id: 1, to_id: 2, t: [1, 2, 3], t: [9, 9, 9], not_t: [1], q: [0, 0, 0, 2], cov_diag: [1, 1, 1, 1, 1, 1], fitness: [3], my_fitness: 4}",
        "from_id: 3\n    to_id: 4\n    fitness:\n    at_kf: 7\n    t: [1,\n       2, 3]\n    q: [0, 0, 0, 1]\n    cov_diag: [1, 1, 1, 1, 1, 1]",
        "from_id: 5\n    to_id: 6\n    t: [1, 2, 3]\n    q: [0, 0, 0, 1]\n    cov_diag: [1, 1, 1, 1, 1, 1]\n    cov: [1",
    ]
    (tmp_path / "a.yaml").write_text("loops:\n" + "".join(f"  - {i}\n" for i in items))
    df = codecs.read_loops_yaml(spark, str(tmp_path))
    a, b, c = sorted(df.collect(), key=lambda r: r.from_id)
    assert (a.t, a.q, a.fitness, a.problem) == ([1, 2, 3], [0, 0, 0, 1], 0.8, None)
    assert (b.t, b.fitness, b.at_kf, b.problem) == ([1, 2, 3], 0.8, 7, None)
    assert c.problem == "cov must have 36 entries"
    plan = df.filter("problem is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cov_diag):") == 1 and plan.count("from_id:") <= 2


def test_loops_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(30):
        q = rng.normal(0, 1, 4)
        q /= np.linalg.norm(q)
        rows.append((i, i + 5, rng.normal(0, 1, 3).tolist(), q.tolist(), rng.normal(0, 1, 36).tolist() if i % 2 else None, None if i % 2 else rng.random(6).tolist(), float(rng.random()), None, bool(i % 3)))
    df = spark.createDataFrame(rows, codecs.LOOP)
    codecs.write_loops_yaml(df.repartition(3), str(tmp_path / "l"))
    got = {r.from_id: r for r in codecs.read_loops_yaml(spark, str(tmp_path / "l")).collect()}
    assert len(got) == 30
    for i, j, t, q, cov, diagonal, fitness, _, outlier in rows:
        r = got[i]
        assert (r.to_id, r.at_kf, r.fitness, r.outlier, r.problem) == (j, j, fitness, outlier, None) and r.t == t and np.allclose(r.q, q)
        assert np.allclose(r.cov, cov if cov else np.diag(diagonal).ravel())


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png(colour):
    import struct
    import zlib

    rng = np.random.default_rng(colour)
    grey = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    assert codecs.png_grey(codecs.png(grey.tobytes(), 5, 7)) == (5, 7, grey.tobytes())
    n = codecs.CHANNELS[colour]
    pixels = rng.integers(0, 256, (6, 4, n)).astype(np.int64)
    lines, before = [], np.zeros((4, n), np.int64)
    for y, row in enumerate(pixels):
        left, corner = np.concatenate([np.zeros((1, n), np.int64), row[:-1]]), np.concatenate([np.zeros((1, n), np.int64), before[:-1]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        lines.append(bytes([y % 5]) + ((row - [0 * row, left, before, (left + before) // 2, paeth][y % 5]) % 256).astype(np.uint8).tobytes())
        before = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = zlib.compress(b"".join(lines))
    file = codecs.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, colour, 0, 0, 0)) + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")
    want = pixels[:, :, 0] if n < 3 else (299 * pixels[:, :, 0] + 587 * pixels[:, :, 1] + 114 * pixels[:, :, 2] + 500) // 1000
    assert codecs.png_grey(file) == (4, 6, want.astype(np.uint8).tobytes())
    for broken in (file[:20], file[:40] + b"x" + file[41:], b"", b"JFIF"):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            codecs.png_grey(broken)


def test_images_in_spark(spark):
    grey = bytes(range(24))
    rows = [(1, codecs.png(grey, 8, 3)), (2, b"short"), (3, None), (4, codecs.png(grey, 8, 3)[:-12]), (5, codecs.png(grey, 8, 3)[:-14])]
    got = {r.id: (r.image.width, r.image.pixels) for r in codecs.decode_image_compressed(spark.createDataFrame(rows, "id long, data binary")).collect()}
    assert got == {1: (8, bytearray(grey)), 2: (None, None), 3: (None, None), 4: (8, bytearray(grey)), 5: (None, None)}


def test_packet_log_overwrite(spark, tmp_path):
    spark.dataSource.register(packet_log.PacketLog)
    rows = lambda n: [("keyframe", i, i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(n)]
    path = str(tmp_path / "log")
    for n, mode, total in ((20, "append", 20), (7, "append", 27), (5, "overwrite", 5), (3, "append", 8), (0, "overwrite", 0)):
        spark.createDataFrame(rows(n), packet_log.SCHEMA).repartition(2).write.format("packetlog").mode(mode).save(path)
        assert spark.read.format("packetlog").load(path).count() == total


def test_trajectories_of_many_runs_are_few_files(spark, tmp_path):
    rows = [(run, 10.0 + k / 2, float(run), float(k), 0.5, 0.0, 0.0, 0.0, 1.0) for run in (*range(300), None) for k in (2, 0, 1) if run is not None]
    rows += [(None, 1.0, -1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0)]
    poses = spark.createDataFrame(rows, "run long, stamp double, " + ", ".join(f"{c} double" for c in codecs.POSE))
    codecs.write_tum(poses.repartition(3), str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("*.txt"))
    assert 0 < len(files) <= 8
    back = codecs.read_tum_runs(spark, str(tmp_path / "out"))
    got = codecs.parse_tum(back, ["run"]).select(F.col("run").cast("long"), "stamp", *codecs.POSE).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    # the lines of a run stand together, in the order of their stamps
    text = "".join(f.read_text() for f in files)
    assert "# run 7\n10.000000 7.000000000 0.000000000 0.500000000 0.000000000 0.000000000 0.000000000 1.000000000\n10.500000 7.000000000 1.0" in text and text.count("# run") == 301
