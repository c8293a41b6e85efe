"""Beat matching against an augmenting-path matching."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import pairing as P
from tonegrid.operators.pairing import beat_f_measure


def most(ref, est, tol):
    taken = {}

    def place(i, seen):
        for j, e in enumerate(est):
            if abs(e - ref[i]) <= tol and j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(ref)))


def test_beats_match_one_to_one(spark):
    rng = random.Random(1)
    songs = {}
    for song in range(12):  # in 1/64 s, so that sums are exact; dense enough for chains
        songs[song] = [sorted(rng.sample(range(0, 9000, 2 + song % 3), 60 + 10 * song)) for _ in range(2)]
    songs[12] = [[5], []]
    rows = [(s, k, v / 64) for s, both in songs.items() for k in (0, 1) for v in both[k]]
    df = spark.createDataFrame(rows, "song_id long, k int, t double")
    got = {r["song_id"]: r["f_measure"] for r in beat_f_measure(df.where("k = 0"), df.where("k = 1"), ["song_id"], "t", 5 / 64).collect()}
    for s, (ref, est) in songs.items():
        m = most(ref, est, 5)
        p, q = m / len(est) if est else 0, m / len(ref)
        assert abs(got[s] - (2 * p * q / (p + q) if m else 0)) < 1e-9


def test_summary_equals_the_pairings(spark, monkeypatch):
    """Means and best pairings from blocks of seven against every pairing in a row of its own, missing values included."""
    monkeypatch.setattr(P, "BLOCK", 7)
    rng = np.random.default_rng(2)
    kinds = ["verse", "chorus", "drop", "instrumental", "intro", None]
    rows = []
    for song, count in ((1, 30), (2, 25), (3, 1), (4, 8)):
        for i in range(count):
            energy = None if song == 4 and i == 3 else round(float(rng.random()), 1)
            rows.append((song, i, energy, None if i == 5 else float(rng.integers(0, 5) * 500), bool(rng.random() < 0.5), kinds[rng.integers(0, 6)]))
    sections = spark.createDataFrame(rows, "song_id long, section_idx long, energy double, spectral_centroid double, has_vocals boolean, classification string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 2, 3), (12, 4, 1), (13, 1, 99), (14, 1, 1)], "pair_id long, song_a long, song_b long")
    keys = pairs.select("pair_id", (F.col("pair_id") / 20).alias("key_score"))
    every = P.section_pairings(pairs, sections, keys).toPandas()
    summary = P.pairing_summary(pairs, sections, keys, n=6)
    best = {r["pair_id"]: r for r in P.best_direction(summary).collect()}
    means = every.groupby(["pair_id", "direction"]).overall_score.mean()
    assert set(best) == {10, 11, 12, 14}
    for pair, r in best.items():
        assert abs(r["direction_score_a"] - means[pair, "a_vocals"]) < 1e-12 and abs(r["direction_score_b"] - means[pair, "b_vocals"]) < 1e-12
    every["order"] = -every.overall_score.round(12)
    for direction in ("a_vocals", "b_vocals", None):
        got = P.top_pairings(summary, direction).toPandas()
        for pair, rows in got.groupby("pair_id"):
            chosen = direction or best[pair]["best_direction"]
            want = every[(every.pair_id == pair) & (every.direction == chosen)].sort_values(["order", "section_a", "section_b"]).head(6)
            rows = rows.sort_values("rank")
            assert rows[["section_a", "section_b"]].values.tolist() == want[["section_a", "section_b"]].values.tolist()
            assert np.allclose(rows.overall_score, want.overall_score) and set(rows.direction) == {chosen}


def greedy(ref, est, tol):
    """Matches of the plain loop over all beats."""
    waiting, hits = [], 0
    for t, k in sorted([(t, 0) for t in ref] + [(t, 1) for t in est]):
        waiting = [w for w in waiting if t - w[0] <= tol]
        if waiting and waiting[0][1] != k:
            waiting.pop(0)
            hits += 1
        else:
            waiting.append((t, k))
    return hits


@pytest.mark.parametrize("beats", [16, 4096])
def test_one_stretch_over_a_whole_song(spark, monkeypatch, beats):
    """Beats 10 ms apart: the song is one stretch, cut into chunks that hand their open beats on."""
    monkeypatch.setattr(P, "BEATS", beats)
    rng = random.Random(5)
    songs = {1: ([i / 100 for i in range(400)], [i / 100 + 0.05 for i in range(0, 400, 3)]),
             2: ([i / 50 + rng.random() / 200 for i in range(300)], [i / 40 + rng.random() / 100 for i in range(240)]),
             3: ([0.5, 9.0], [0.52])}
    make = lambda side: spark.createDataFrame([(k, t) for k, v in songs.items() for t in v[side]], "song_id long, t double")
    got = {r["song_id"]: r["f_measure"] for r in P.beat_f_measure(make(0), make(1), ["song_id"], "t").collect()}
    for song, (ref, est) in songs.items():
        assert abs(got[song] - 2 * greedy(ref, est, 0.07) / (len(ref) + len(est))) < 1e-12
