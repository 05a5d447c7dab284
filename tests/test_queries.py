"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from posegrid.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float | np.floating) and np.isnan(v)):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating):
        return f"{round(float(v), 5) + 0.0}"
    return str(v)


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].map(plain).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0 and len(got) > 0
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_graph_and_registration_queries_read_whole_tables(spark):
    """Each run with an edge or a loop, each pair of clouds and each sweep comes out."""
    orders, lines = (pd.read_parquet(f"{SMALL}/{t}.parquet") for t in ("orders", "lineitem"))
    poses = orders.groupby("o_custkey").size()
    runs = {k: set(poses[poses >= k].index) for k in (1, 2, 4)}
    loops = int(sum(sum(b % 2 == 0 for b in range(4, n + 1)) for n in poses))
    got = lambda name: QUERIES[name](spark, SMALL).toPandas()
    chain = got("graph_add_keyframe")
    edges = int((poses - 1).sum())
    # a verdict on every packet, the first of each run is its prior
    assert set(chain["run"]) == runs[1] and len(chain) == len(orders) and (chain["verdict"] == "prior").sum() == len(poses)
    assert len(got("synth_loops")) == len(got("gnc_consolidate")) == len(got("pcm_decide")) == loops
    assert set(got("max_clique")["run"]) == runs[4]
    assert len(got("pose_graph_optimize")) == len(got("marginal")) == len(orders) and len(got("gnss_factor")) == edges
    pairs = set(lines["l_orderkey"] // 200)
    for name in ("icp_register", "icp_covariance"):
        assert set(got(name)["pair"]) == pairs
    # thirty-six scans are a keyframe, forty of which a run; each one of the second lap is compared
    second = {(k // 40, k % 40) for k in set(lines["l_orderkey"] // 36) if k % 40 >= 20}
    for name in ("loop_verify", "loop_self_test"):
        found = got(name)
        assert set(zip(found["run"], found["q"], strict=True)) == second
    sweeps = got("process_sweep")
    assert sorted(zip(sweeps["run"], sweeps["k"], strict=True)) == sorted({(k // 40, k % 40) for k in lines["l_orderkey"] // 75})
    # a pair's cloud is all points of its 200 scans: no fewer matches than points in reach of a copy moved by 0.022
    assert got("icp_register")["n"].sum() == len(lines)


def test_alignment_of_points_that_fit_a_mirror_better(spark, tmp_path):
    """Few poses of almost the same x: their errors outweigh their spread, and the best turn in space is half a turn about a line of the plane."""
    rng = np.random.default_rng(3)
    kf = rng.choice(90_000, (60, 3), replace=False)
    orders = [(int(k), run, float(t)) for run, ids in enumerate(kf.tolist()) for k, t in zip(ids, 100_000 + 200 * rng.random(3), strict=True)]
    orders = pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_totalprice"]).assign(o_orderdate=pd.Timestamp("1996-01-01"))
    orders["o_orderdate"] = orders["o_orderdate"].astype("datetime64[us]")
    orders.to_parquet(tmp_path / "orders.parquet")
    got = QUERIES["umeyama_align"](spark, str(tmp_path)).toPandas().sort_values("run").reset_index(drop=True)
    assert 10 < (got["r8"] < 0).sum() < 50
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        expected = con.execute(SQL["umeyama_align"]).df().sort_values("run").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, rtol=0, atol=1e-4)
