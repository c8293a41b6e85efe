"""Echo tails against a plain loop over the phrases."""

import numpy as np
import pytest

from tonegrid.operators import timeline as L


def plain(track, phrases, beat, total, repeats, window):
    out = np.concatenate([track, np.zeros(max(0, total - len(track)))])
    for start, end in phrases:
        end = min(end, total)
        if end <= start:
            continue
        src = out[end - min(window, end - start):end].copy()
        if np.abs(src).max() < 1e-7:
            continue
        tail = np.zeros(beat * repeats + len(src))
        for i in range(1, repeats + 1):
            tail[i * beat:i * beat + len(src)] += src * 0.30 * 0.5 ** (i - 1)
        tail *= (np.sqrt(np.mean(src**2)) + 1e-8) * 0.20 / (np.sqrt(np.mean(tail[tail != 0] ** 2)) + 1e-8)
        n = min(len(tail), total - end)
        out[end:end + n] += tail[:n]
    return out


@pytest.mark.parametrize("repeats", [1, 3])
def test_echoes_hear_echoes(spark, repeats):
    rng = np.random.default_rng(1)
    phrases = {1: [(0, 60), (50, 120), (100, 130), (400, 460), (420, 455), (300, 410), (480, 700)], 2: [(10, 5), (20, 90)], 3: [(0, 40), (45, 80)]}
    tracks = {1: rng.normal(size=600), 2: rng.normal(size=200), 3: np.zeros(300)}
    tracks[1][100:131] = 0.0
    rows = [(k, i, float(x)) for k, t in tracks.items() for i, x in enumerate(t)]
    places = [(k, i, a, b) for k, p in phrases.items() for i, (a, b) in enumerate(p)]
    got = L.echo_tails(spark.createDataFrame(rows, "song long, pos long, x double"), spark.createDataFrame(places, "song long, ord long, dest_start long, dest_end long"),
                       ["song"], "pos", "x", 240.0, 560, repeats, sr=100).toPandas()
    for song, track in tracks.items():
        want = plain(track, phrases[song], 25, 560, repeats, 30)
        have = np.zeros(max(600, len(want)))
        mine = got[got.song == song]
        have[mine.pos] = mine.x
        assert np.allclose(have[:len(want)], want) and not have[len(want):].any()


def test_no_phrases(spark):
    track = spark.createDataFrame([(1, 0, 0.5)], "song long, pos long, x double")
    none = spark.createDataFrame([], "song long, ord long, dest_start long, dest_end long")
    assert [tuple(r) for r in L.echo_tails(track, none, ["song"], "pos", "x", 120.0, 10).collect()] == [(1, 0, 0.5)]
