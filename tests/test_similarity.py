import numpy as np
import pandas as pd
import pytest

from tonegrid.operators import balls
from tonegrid.operators import similarity as M


@pytest.fixture(scope="module")
def vectors(spark):
    """300 clustered unit vectors; a third are copies of one."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(6, 8))
    v = centre[rng.integers(0, 6, 300)] + 0.15 * rng.normal(size=(300, 8))
    v[::3] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"song_id": range(300), "embedding": [r.astype("float32").tolist() for r in v]}),
                               "song_id long, embedding array<float>")
    return v.astype("float32").astype("float64"), df


def scores(v):
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -np.inf)
    return s


def test_best_match_with_copies(vectors):
    v, df = vectors
    got = M.best_match(df, block_rows=32).toPandas().set_index("song_id")
    s = scores(v)
    assert (got.loc[range(300)].match_id.to_numpy() == s.argmax(axis=1)).all()


def test_top_pairs_with_copies(vectors):
    v, df = vectors
    n = 150
    got = M.top_pairs(df, n, block_rows=32).toPandas()
    s = scores(v)
    pairs = sorted((-s[i, j], i, j) for i in range(300) for j in range(i + 1, 300))[:n]
    assert list(zip(got.song_a, got.song_b)) == [(i, j) for _, i, j in pairs]


def test_top_matches_lists(vectors):
    v, df = vectors
    q = M._vectors(df, "song_id", "embedding")
    got = M.top_matches(q, q, 4, skip_same=True, block_rows=50).toPandas()
    s = scores(v)
    for i, g in got.groupby("id"):
        want = sorted((-s[i, j], j) for j in range(300) if j != i)[:4]
        assert sorted(g.match) == sorted(j for _, j in want), i


def test_mixed_widths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).round(3).tolist()) for i in range(40)] + [(40, None), (41, [1.0, 2.0])]
    emb = spark.createDataFrame(rows, "song_id long, embedding array<double>")
    dot = lambda a, b: round(float(np.dot(a, b)), 9) if a and b and len(a) == len(b) else None
    got = M.best_match(emb).toPandas().set_index("song_id")
    pairs = []
    for i, a in rows:
        scored = sorted((-s, j) for j, b in rows if j != i and (s := dot(a, b)) is not None)
        assert (got.loc[i].match_id == scored[0][1]) if scored else pd.isna(got.loc[i].match_id)
        pairs += [(s, min(i, j), max(i, j)) for s, j in scored if i < j]
    top = M.top_pairs(emb, 7).toPandas()
    assert list(zip(top.song_a, top.song_b)) == [(a, b) for _, a, b in sorted(pairs)[:7]]
    songs = spark.createDataFrame([(i, 120.0, "C major") for i, _ in rows], "song_id long, tempo double, key string")
    following = M.next_song(songs, emb).toPandas().set_index("song_id")
    for i, a in rows:
        # equal keys and tempos: the embedding decides, another width counts as none
        best = min((-(dot(a, b) or 0.0), j) for j, b in rows if j != i)
        assert following.loc[i].next_id == best[1]


def test_blocks_moved(spark):
    """Clustered vectors: most node pairs are never joined, and what moves is blocks, not vectors times blocks."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 12))
    v = centre[np.arange(4000) % 8] + 0.02 * rng.normal(size=(4000, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"id": range(4000), "vec": v.tolist()}), "id long, vec array<double>")
    trace = []
    got = M.top_matches(df, df, 3, skip_same=True, block_rows=16, trace=trace).toPandas()
    s = scores(v)
    want = np.sort(s, axis=1)[:, :-4:-1]
    assert np.allclose(got.sort_values(["id", "score"], ascending=[True, False]).score.to_numpy().reshape(4000, 3), want)
    nodes = -(-4000 // (16 * balls.FAN))
    pairs = sum(t.count() for t in trace)
    assert len(trace) > 1 and pairs < 0.6 * nodes**2
    assert 2 * balls.FAN * pairs < 4000 * nodes / 4  # blocks of both sides, against a row per vector and node


def test_next_song_by_key_profiles(spark):
    """With key profiles the key score is their best rotated correlation; songs without one fall back on the key's name."""
    rng = np.random.default_rng(8)
    e = rng.normal(size=(30, 6))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    profile = rng.random(size=(30, 12))
    songs = spark.createDataFrame([(i, 120.0, "C major", None if i % 5 == 0 else profile[i].tolist()) for i in range(30)], "song_id long, tempo double, key string, key_chroma array<double>")
    emb = spark.createDataFrame([(i, e[i].tolist()) for i in range(30)], "song_id long, embedding array<double>")
    got = M.next_song(songs, emb, k=2).toPandas()

    def key(i, j):
        if i % 5 == 0 or j % 5 == 0:
            return 1.0
        best = max(np.corrcoef(profile[i], np.roll(profile[j], s))[0, 1] for s in range(12))
        return min(1.0, max(0.0, (best + 0.5) / 1.5))

    for i, rows in got.groupby("song_id"):
        want = sorted((-round(0.5 * e[i] @ e[j] + 0.3 * key(i, j) + 0.2, 9), j) for j in range(30) if j != i)[:2]
        assert rows.sort_values("score", ascending=False).next_id.tolist() == [j for _, j in want]


def test_only_pairs_that_can_reach_a_list_are_scored():
    """Two parts of the score are bounded: a product too low for the floor is never scored, and few products are held at once."""
    rng = np.random.default_rng(2)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 1500, 32)))
    extra, other = rng.random(1500), rng.random(1500)
    scored = []

    def score(q, b, row, col, dots, least):
        scored.append(len(row))
        return 0.5 * dots + 0.5 * (1 - np.abs(q["e"].to_numpy()[row] - b["e"].to_numpy()[col]))

    hits = balls._hits(pd.DataFrame({"e": extra}), pd.DataFrame({"e": other}), x, y, np.full(1500, -np.inf), 3, score, lambda dots: 0.5 * dots + 0.5)
    row, col, value = (np.concatenate(p) for p in zip(*hits))
    whole = 0.5 * (x @ y.T) + 0.5 * (1 - np.abs(extra[:, None] - other[None, :]))
    best = np.argsort(-whole, axis=1)[:, :3]
    found = set(zip(row.tolist(), col.tolist()))
    assert all((i, j) in found for i in range(1500) for j in best[i].tolist())
    assert np.allclose(value, whole[row, col], atol=1e-12)
    assert max(scored) <= balls.SCORED and sum(scored) < 0.25 * whole.size
