import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonegrid.operators.vibrato import prominent_peaks, vibrato


def brute(v, p):
    """Strict local maxima whose lower side minimum, up to higher ground or the edge, is p below."""
    out = []
    for i in range(1, len(v) - 1):
        if not (v[i] > v[i - 1] and v[i] > v[i + 1]):
            continue
        lows = []
        for step in (-1, 1):
            j, low = i, v[i]
            while 0 <= j < len(v) and v[j] <= v[i]:
                low = min(low, v[j])
                j += step
            lows.append(low)
        if v[i] - max(lows) >= p:
            out.append(i)
    return out


def test_peaks_across_chunks(spark):
    rng = np.random.default_rng(6)
    data = {f"w{n}_{i}": np.cumsum(rng.normal(size=n)) if i % 2 else rng.normal(size=n) for n in (2, 10, 37, 90) for i in range(12)}
    d = spark.createDataFrame(pd.DataFrame([(k, i, float(i), float(x)) for k, v in data.items() for i, x in enumerate(v)], columns=["k", "i", "t", "x"]))
    for chunk in (3, 10, 1000):
        got = prominent_peaks(d, ["k"], "i", "t", "x", 1.2, chunk=chunk).toPandas()
        for k, v in data.items():
            assert sorted(got[got.k == k].t.astype(int)) == brute(v, 1.2), (k, chunk)


def test_modulated_tone(spark):
    t = np.arange(400) * 0.005
    f0 = 220 * 2 ** (50 * np.sin(2 * np.pi * 5.5 * t) / 1200)
    rows = [("vib", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, f0))] + [("flat", i, i * 0.005, 220.0) for i in range(50)] + [("none", 0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "song_id string, i long, t double, f0 double")
    got = {r.song_id: r for r in vibrato(d, ["song_id"], "i", "t", "f0", chunk=64).collect()}
    assert got["vib"].detected and abs(got["vib"].rate_hz - 5.5) < 0.3 and abs(got["vib"].depth_cents - 2 * 50 / np.sqrt(2)) < 3
    assert not got["flat"].detected and not got["none"].detected and got["none"].rate_hz == 0
