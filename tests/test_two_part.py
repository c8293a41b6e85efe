import numpy as np
import pytest

from tonegrid.operators import learning as R
from tonegrid.operators import two_part


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SONGS": 7, "QUERIES": 5, "PAIRS": 16, "LEAST": 4, "WIDE": 3, "LONG": 6}.items():
        monkeypatch.setattr(two_part, name, value)


def tables(spark):
    rng = np.random.default_rng(3)
    vecs = {i: rng.normal(size=4 if i % 5 else 3).round(1) for i in range(30)}
    vecs[7], vecs[8] = vecs[6], np.zeros(4)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in vecs.items()] + [(30, None)], "song_id long, embedding array<float>")
    pick = lambda n: [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 32, size=(n, 2)))]
    asked, mixes = pick(17), pick(120)
    mixes += [(200 + i, 6, 9) for i in range(9)] + [(300 + i, 7, 9) for i in range(9)]
    vecs = {i: v.astype(np.float32).astype(float) for i, v in vecs.items()}
    return emb, asked, mixes, vecs


def brute(asked, mixes, vecs, k):
    out = {}
    for p, a, b in asked:
        if a in vecs and b in vecs:
            found = []
            for m, c, d in mixes:
                if c in vecs and d in vecs and len(vecs[a]) == len(vecs[c]) and len(vecs[b]) == len(vecs[d]):
                    x, y = np.concatenate([vecs[a], vecs[b]]), np.concatenate([vecs[c], vecs[d]])
                    size = lambda v: np.linalg.norm(v) or 1.0
                    found.append((-round(x @ y / size(x) / size(y), 9), m))
            out[p] = [m for _, m in sorted(found)[:k]]
    return {p: ms for p, ms in out.items() if ms}


def test_nearest_rated_from_ids_equals_brute_force(spark, small, monkeypatch):
    emb, asked, mixes, vecs = tables(spark)
    written = []
    keep = two_part.materialize
    monkeypatch.setattr(two_part, "materialize", lambda d, name: written.append(keep(d, name)) or written[-1])
    pairs = spark.createDataFrame(asked, "pair_id long, song_a long, song_b long")
    rated = spark.createDataFrame(mixes, "mix_id long, song_a long, song_b long")
    got = {}
    for r in R.nearest_rated(pairs, rated, emb, 5).orderBy("pair_id", (-1 * two_part.F.col("similarity")), "mix_id").collect():
        got.setdefault(r.pair_id, []).append(r.mix_id)
    assert got == brute(asked, mixes, vecs, 5)
    # no table that has a row or an entry per mix has vectors
    for d in written:
        if {"song_a", "sa"} & set(d.columns):
            assert not [f.name for f in d.schema.fields if "float" in f.dataType.simpleString()]


def test_nothing_to_compare(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0])], "song_id long, embedding array<float>")
    pairs = spark.createDataFrame([(1, 1, 1)], "pair_id long, song_a long, song_b long")
    assert R.nearest_rated(pairs, spark.createDataFrame([], "mix_id long, song_a long, song_b long"), emb).count() == 0


def test_suggestion_reads_rated_mixes_without_vectors(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "song_id long, embedding array<float>")
    params = "mix_id long, song_a long, song_b long, direction string, key_shift int, vox_rms double, inst_rms double, duck_depth double, comp_threshold double, rating int"
    rated = spark.createDataFrame([(m, 1, 2 + m % 2, "b_vocals", 2, 0.1, 0.2, 0.3, -18.0, 5) for m in range(4)] + [(9, 8, 9, "a_vocals", 0, 0.1, 0.2, 0.3, -18.0, 4)], params)
    near = R.nearest_rated(spark.createDataFrame([(1, 3, 2)], "pair_id long, song_a long, song_b long"), rated, emb, 2)
    got = R.weighted_suggestion(near.join(rated.drop("song_a", "song_b"), "mix_id")).collect()
    assert [(r.pair_id, r.direction, r.key_shift) for r in got] == [(1, "b_vocals", 2)]


def test_own_history_counts_without_vectors(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "song_id long, embedding array<float>")
    params = "mix_id long, song_a long, song_b long, direction string, key_shift int, vox_rms double, inst_rms double, duck_depth double, comp_threshold double, rating int"
    rated = spark.createDataFrame([(m, 1, 2, "a_vocals", 2, 0.1, 0.2, 0.3, -18.0, 5) for m in range(3)] + [(9, 8, 9, "b_vocals", 0, 0.1, 0.2, 0.3, -18.0, 4)], params)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 8, 9)], "pair_id long, song_a long, song_b long")
    got = {r.pair_id: (r.direction, r.vox_rms) for r in R.suggest_params(pairs, rated, emb).collect()}
    assert got[1][0] == "a_vocals" and abs(got[1][1] - 0.1) < 1e-12 and got[2] == ("b_vocals", None)


def test_cells_meet_their_songs_without_a_join_of_their_own(spark, small):
    """Apart from the few names and jobs, which are copied, cells, songs and queries are joined with nothing."""
    emb, asked, mixes, _ = tables(spark)
    frame = lambda rows: spark.createDataFrame(rows, "id long, song_a long, song_b long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = two_part.nearest_pairs(frame(asked), frame(mixes), emb, 3)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum("Join " in line for line in plan.splitlines()) <= 4


def test_pairs_of_a_cell_share_its_songs_and_gather_in_small_rows(spark, monkeypatch):
    """Six song blocks make the grid although one could hold all songs; a row of a cell has about so many pairs as are asked for, however many the cell has."""
    for name, value in {"CELLS": 36, "LEAST": 20, "GATHERED": 20}.items():
        monkeypatch.setattr(two_part, name, value, raising=False)
    rng = np.random.default_rng(5)
    emb = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "song_id long, embedding array<double>")
    mixes = spark.createDataFrame([(m, int(a), int(b)) for m, (a, b) in enumerate(rng.integers(0, 60, size=(6000, 2)))], "id long, song_a long, song_b long")
    written = {}
    keep = two_part.materialize
    monkeypatch.setattr(two_part, "materialize", lambda d, name: written.setdefault(name, keep(d, name)))
    two_part.nearest_pairs(mixes.limit(3), mixes, emb, 2).count()
    rows = written["pair-cells"].collect()
    songs = {}
    for r in rows:
        for s in ("sa", "sb"):
            songs.setdefault((r.cell, s), set()).update(r[s])
    assert sum(len(v) for v in songs.values()) <= 2 * 6 * 60 and max(len(r.ids) for r in rows) < 3 * 20
