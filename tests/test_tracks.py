import numpy as np

from tonegrid import plans
from tonegrid.operators import spectral as Z


def test_tracks_hold_their_own_samples(spark):
    stems = ["drums", "bass", "drums", "vocals", "other", "bass", "drums"]
    rows = [(7, i, float(i + 1), s) for i, s in enumerate(stems)]
    got = Z.pack_tracks(spark.createDataFrame(rows[::-1], "song long, pos long, x double, stem string"), ["song"], "pos", "x", "stem", ["drums", "bass"], 4).collect()
    x = np.arange(1.0, 8.0)
    heard = {"mix": x, "drums": x * [s == "drums" for s in stems], "bass": x * [s == "bass" for s in stems]}
    assert {(r.track, r.chunk): r.pcm for r in got} == {(k, c): v[4 * c:4 * c + 4].tolist() for k, v in heard.items() for c in (0, 1)}


def test_embedding_frames_every_track_once(spark):
    """Chunks are joined with their successors and songs with their tempo; no frame is joined with itself."""
    plan = plans.queries()["d31_handcrafted_embedding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2
