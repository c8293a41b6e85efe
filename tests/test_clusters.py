import numpy as np
import pytest

from tonegrid.operators.clusters import series_kmeans
from tonegrid.operators.spectral import _running_median, harmonic_ratio


def brute(v, k, rounds):
    """Lloyd's rounds from evenly spaced rows, ties to the smaller number, empty clusters keep their centre."""
    c = np.array([v[(2 * j + 1) * len(v) // (2 * k)] for j in range(k)])
    near = lambda: np.argmin(((v[:, None, :] - c[None]) ** 2).sum(-1), axis=1)
    for _ in range(rounds):
        at = near()
        c = np.array([v[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
    return near()


SCHEMA = "song string, i long, v array<double>, note string"


@pytest.mark.parametrize("stretch", [7, 8192])
def test_clusters_equal_plain_rounds(spark, stretch):
    rng = np.random.default_rng(3)
    songs = {"hot": rng.normal(size=(300, 3)) + rng.integers(0, 4, size=(300, 1)) * 3, "short": rng.normal(size=(9, 3)), "one": rng.normal(size=(1, 3)),
             "same": np.ones((25, 3)), "mid": rng.normal(size=(47, 3))}
    rows = [(s, i, [float(x) for x in r], "kept") for s, v in songs.items() for i, r in enumerate(v)]
    got = series_kmeans(spark.createDataFrame(rows, SCHEMA), ["song"], "i", "v", 3, rounds=6, stretch=stretch)
    assert got.columns == ["song", "i", "v", "note", "cluster"]
    got = got.toPandas()
    assert len(got) == len(rows)
    for s, v in songs.items():
        want = brute(v, min(8, max(2, len(v) // 10)), 6)
        assert got[got.song == s].sort_values("i").cluster.tolist() == want.tolist(), s


def test_clusters_of_odd_rows(spark):
    bad = [("a", 0, None, ""), ("a", 1, [1.0, None], ""), ("a", 2, [1.0], ""), ("a", 5, [0.0, 0.0], ""), ("a", 9, [4.0, 4.0], ""), ("b", 0, None, "")]
    got = series_kmeans(spark.createDataFrame(bad, SCHEMA), ["song"], "i", "v", 2).collect()
    assert sorted((r.song, r.i, r.cluster) for r in got) == [("a", 5, 0), ("a", 9, 1)]
    assert series_kmeans(spark.createDataFrame([], SCHEMA), ["song"], "i", "v", 2).count() == 0


def test_running_median_in_slices():
    rng = np.random.default_rng(4)
    for shape, k in (((40, 33), 31), ((1, 5), 3), ((300, 7), 13)):
        m = rng.normal(size=shape)
        for axis in (0, 1):
            if k // 2 > shape[axis]:
                continue
            width = [(0, 0), (0, 0)]
            width[axis] = (k // 2, k // 2)
            want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, width, mode="symmetric"), k, axis=axis), axis=-1)
            for cells in (1, 100, 1 << 20):
                assert np.array_equal(_running_median(m, k, axis, cells), want)


def test_short_phrases_share_python_calls(spark):
    """Phrases of several lengths, cut into chunks or not, in batches and not one by one."""
    rng = np.random.default_rng(4)
    rows = [(s, p, i, [float(x) for x in rng.random(9)]) for s in range(2) for p, n in enumerate((1, 3, 8, 8, 21)) for i in range(n)]
    frames = spark.createDataFrame(rows, "song long, phrase long, i long, mag array<float>")
    whole = harmonic_ratio(frames, ["song", "phrase"], "i", kernel=5)
    assert "FlatMapGroups" not in whole._jdf.queryExecution().optimizedPlan().toString()
    cut = harmonic_ratio(frames, ["song", "phrase"], "i", kernel=5, chunk=4)
    got, parts = ({(r.song, r.phrase): r.harmonic_ratio for r in d.collect()} for d in (whole, cut))
    want = {}
    for song in range(2):
        for phrase in range(5):
            m = np.array([r[3] for r in rows if r[:2] == (song, phrase)]).astype(np.float32).astype(float)
            h, p = _running_median(m, min(5, 2 * len(m) - 1), 0), _running_median(m, 5, 1)
            level = lambda a, b: np.sqrt(((m * a ** 2 / (a ** 2 + 9 * b ** 2)) ** 2).sum() / len(m))
            want[song, phrase] = level(h, p) / (level(h, p) + level(p, h) + 1e-8)
    assert got == pytest.approx(want, abs=1e-9) and parts == pytest.approx({k: v for k, v in want.items()}, abs=1e-9)
