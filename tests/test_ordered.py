"""Series building blocks against plain loops, with chunks small enough to be crossed often."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import ordered
from tonegrid.operators import signal as X
from tonegrid.operators.folds import spaced_points
from tonegrid.operators.intervals import interval_join, nearest
from tonegrid.operators.ordered import carry, dense_index, halo_window, quantiles, runs

LENGTHS = [1, 2, 5, 7, 8, 23, 60, 121]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{n}", i, float(v)) for n in LENGTHS for i, v in enumerate(np.round(rng.random(n), 2))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "i", "x"])).cache()


def by_key(df, col):
    pdf = df.orderBy("k", "i").toPandas()
    return {k: g[col].tolist() for k, g in pdf.groupby("k")}


def test_halo_window_equals_whole_window(series):
    got = by_key(halo_window(series, ["k"], "i", 3, 2, {"s": lambda w: F.sum("x").over(w.rowsBetween(-3, 2))}, chunk=7), "s")
    for k, x in by_key(series, "x").items():
        want = [sum(x[max(0, i - 3):i + 3]) for i in range(len(x))]
        assert np.allclose(got[k], want)


def test_moving_average_like_convolution(series):
    for k in (4, 5, 16):
        got = by_key(X.moving_average(series, ["k"], "i", ["x"], k, chunk=20), "x")
        for key, x in by_key(series, "x").items():
            want = x if len(x) < k else np.convolve(x, np.ones(k) / k, mode="same")
            assert np.allclose(got[key], want), (key, k)


@pytest.mark.parametrize("backward", [False, True])
def test_carry(series, backward):
    got = by_key(carry(series, ["k"], "i", F.when(F.col("x") > 0.8, F.col("x")), "c", backward=backward, chunk=6), "c")
    for k, x in by_key(series, "x").items():
        seq, last, want = x[::-1] if backward else x, None, []
        for v in seq:
            last = v if v > 0.8 else last
            want.append(last)
        want = want[::-1] if backward else want
        assert [None if v is None or np.isnan(v) else v for v in got[k]] == want


@pytest.mark.parametrize("gap", [0, 2])
def test_runs(series, gap):
    r = runs(series.where("x > 0.5"), ["k"], "i", {"s": ("sum", F.col("x"))}, gap=gap, chunk=5).toPandas()
    for k, x in by_key(series, "x").items():
        want, cur = [], None
        for i, v in enumerate(x):
            if v > 0.5:
                if cur and i - cur[1] <= gap + 1:
                    cur = [cur[0], i, cur[2] + v]
                else:
                    if cur:
                        want.append(cur)
                    cur = [i, i, v]
        want += [cur] if cur else []
        got = r[r.k == k].sort_values("run_start")[["run_start", "run_end", "s"]].values.tolist()
        assert np.allclose(np.array(got).reshape(-1, 3), np.array(want, dtype=float).reshape(-1, 3)), k


def test_dense_index(series):
    d = dense_index(series, ["k"], ["x", "i"], F.floor(F.col("x") * 4), "r").toPandas()
    for _, g in d.groupby("k"):
        g = g.sort_values(["x", "i"])
        assert g.r.tolist() == list(range(len(g)))


def test_quantiles_exact_on_small_and_large_groups(spark):
    rng = np.random.default_rng(5)
    # one hot group beyond the whole-group bracket, with a value making up a third of it
    hot = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    data = {"hot": hot, "tiny": np.array([3.0]), "two": np.array([1.0, 4.0]), "mid": rng.random(999)}
    pdf = pd.DataFrame([(k, float(v)) for k, vs in data.items() for v in vs], columns=["k", "v"])
    got = quantiles(spark.createDataFrame(pdf), ["k"], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.75}).toPandas().set_index("k")
    for k, vs in data.items():
        assert np.allclose(got.loc[k, ["a", "b", "c", "d"]].astype(float), np.percentile(vs, [10, 50, 90, 75])), k


def test_nearest_ties_go_to_the_earlier(spark):
    rng = np.random.default_rng(9)
    grid = {f"g{n}": np.unique(np.round(rng.random(n) * 300)) for n in (0, 1, 3, 40)}
    pts = {k: np.round(rng.random(30) * 300 * 2) / 2 for k in grid}
    g = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, vs in grid.items() for v in vs], columns=["k", "g"]))
    p = spark.createDataFrame(pd.DataFrame([(k, i, float(v)) for k, vs in pts.items() for i, v in enumerate(vs)], columns=["k", "i", "t"]))
    got = nearest(p, g, ["k"], "t", "g", "n", width=16.0).toPandas()
    assert len(got) == 120
    for r in got.itertuples():
        want = None if not len(grid[r.k]) else grid[r.k][np.argmin(np.abs(grid[r.k] - r.t))]
        assert (want is None and np.isnan(r.n)) or r.n == want


def test_interval_join(spark):
    p = spark.createDataFrame([("a", float(i)) for i in range(40)], ["k", "t"])
    s = spark.createDataFrame([("a", 0, 3.0, 17.5), ("a", 1, 17.0, 17.0), ("a", 2, 30.0, 39.0)], ["k", "j", "lo", "hi"])
    count = lambda closed: {r["j"]: r["n"] for r in interval_join(p, s, ["k"], "t", "lo", "hi", 4.0, closed).groupBy("j").agg(F.count("*").alias("n")).collect()}
    assert count(False) == {0: 15, 2: 9}
    assert count(True) == {0: 15, 1: 1, 2: 10}


def test_spaced_points(spark):
    rng = np.random.default_rng(1)
    data = {f"p{n}": np.unique(rng.integers(0, 900, n)) for n in (1, 4, 60, 500)}
    d = spark.createDataFrame(pd.DataFrame([(k, int(v)) for k, vs in data.items() for v in vs], columns=["k", "p"]))
    for gap, width in ((6.0, 16.0), (40.0, 40.0), (3.0, 1000.0)):
        got = spaced_points(d, ["k"], "p", gap, width).toPandas()
        for k, vs in data.items():
            want, last = [], -np.inf
            for v in vs:
                if v - last >= gap:
                    want.append(v)
                    last = v
            assert sorted(got[got.k == k].p) == want, (k, gap)


def test_short_series_are_spaced_without_python(spark):
    d = spark.range(4000).selectExpr("id div 4 as k", "(id % 4) * 5 as p")
    got = spaced_points(d, ["k"], "p", 6.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # step tables and their chain, both of series of several chunks only; the picks themselves are columns
    assert plan.count("FlatMapGroupsInPandas") == 2 and "LeftSemi" in plan
    assert {(r.p, r["count"]) for r in got.groupBy("p").count().collect()} == {(0, 1000), (10, 1000)}


def test_bridge_and_drop_like_the_loop(spark):
    rng = np.random.default_rng(2)
    data = {f"v{i}": (rng.random(rng.integers(1, 40)) > 0.6) for i in range(200)}
    d = spark.createDataFrame(pd.DataFrame([(k, i, bool(v)) for k, vs in data.items() for i, v in enumerate(vs)], columns=["k", "i", "on"]))
    b = X.bridge_gaps(d, ["k"], "i", "on", chunk=16)
    got, short = by_key(b, "activity"), by_key(X.drop_short_runs(b, ["k"], "i", "activity", 2, chunk=16), "activity")
    for k, vs in data.items():
        a = vs.astype(float)
        for i in range(1, len(a) - 1):
            if a[i] == 0 and a[max(0, i - 4):i].any() and a[i + 1:i + 4].any():
                a[i] = 0.5
        assert got[k] == a.tolist(), k
        i = 0
        while i < len(a):
            j = i
            while j < len(a) and a[j] > 0:
                j += 1
            if 0 < j - i < 2:
                a[i:j] = 0
            i = max(j, i + 1)
        assert short[k] == a.tolist(), k


def test_ramp_mask_like_the_loop(spark):
    rng = np.random.default_rng(4)
    data = {f"m{i}": np.repeat(rng.random(8) > 0.5, rng.integers(1, 9, 8)).astype(float) for i in range(40)}
    d = spark.createDataFrame(pd.DataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], columns=["k", "i", "m"]))
    got = by_key(X.ramp_mask(d, ["k"], "i", "m", 6, chunk=11), "m")
    for k, m in data.items():
        want, step = m.copy(), np.diff(m)
        for points, a, b in ((np.where(step > 0.5)[0], 0.0, 1.0), (np.where(step < -0.5)[0], 1.0, 0.0)):
            for p in points:
                lo, hi = max(0, p - 3), min(len(m), p + 3)
                want[lo:hi] = np.linspace(a, b, hi - lo)
        assert np.allclose(got[k], want), k


def test_quantiles_keep_infinities_and_check_ranks(spark, monkeypatch):
    inf = float("inf")
    groups = {1: [1.0, 2.0, inf, inf, inf], 2: [1.0, 2.0, 3.0, 4.0, inf], 3: [-inf, 0.0, 0.0, 5.0], 4: [7.0] * 3000 + [8.0] * 100 + [inf] * 20}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    got = {r["k"]: (r["lo"], r["mid"], r["top"]) for r in ordered.quantiles(df, ["k"], F.col("v"), {"lo": 0.0, "mid": 0.5, "top": 1.0}).collect()}
    assert got == {1: (1.0, inf, inf), 2: (1.0, 3.0, inf), 3: (-inf, 0.0, 5.0), 4: (7.0, 7.0, inf)}
    monkeypatch.setattr(ordered, "_WIDTHS", (0.0, 0.0))  # brackets too narrow to hold the rank between two values
    with pytest.raises(Exception, match="outside its bracket"):
        ordered.quantiles(df.where("k = 2"), ["k"], F.col("v"), {"q": 0.6}).collect()
