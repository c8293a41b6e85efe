import numpy as np
import pandas as pd

from tonegrid.operators.quality import lag_products
from tonegrid.operators.signal import active_phrases, activity_rms, bridge_gaps, drop_short_runs, islands


def test_lag_products_over_stretches(spark):
    rng = np.random.default_rng(5)
    series = {"long": rng.normal(size=230), "short": rng.normal(size=3), "edge": rng.normal(size=64), "gap": rng.normal(size=90)}
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v) if k != "gap" or i % 7]
    series["gap"][::7] = 0.0
    d = spark.createDataFrame(pd.DataFrame([*rows, ("short", 3, None)], columns=["k", "i", "x"]).astype({"x": "float64"}))
    for chunk in (8, 32, 1024):
        got = lag_products(d.where("not isnan(x)"), ["k"], "i", "x", 9, chunk=chunk).toPandas().set_index(["k", "lag"]).total
        for k, v in series.items():
            for lag in range(10):
                want = float(v[:len(v) - lag] @ v[lag:]) if lag < len(v) else 0.0
                assert abs(got.get((k, lag), 0.0) - want) < 1e-9, (k, lag, chunk)


def test_phrases_in_one_pass_equal_steps(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{k}", i, float(x)) for k, n in enumerate((5, 60, 150)) for i, x in enumerate(rng.random(n) ** 3)]
    d = spark.createDataFrame(rows, "k string, i long, x double")
    a = drop_short_runs(bridge_gaps(activity_rms(d, ["k"], "i", "x"), ["k"], "i", "active"), ["k"], "i", "activity", 2)
    want = sorted(map(tuple, islands(a, ["k"], "i", "activity", "x").collect()))
    for chunk in (16, 65536):
        got = sorted(map(tuple, active_phrases(d, ["k"], "i", "x", chunk=chunk).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > 5
