import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tonegrid.operators import learning as R


@pytest.mark.parametrize("rows_per_task", [10, 1000])
def test_training_equals_whole_batch_descent(spark, rows_per_task):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 6)), rng.random(50)
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y}))
    got = R.train_layers(df, "x", "y", hidden=(5, 4), epochs=4, lr=0.1, rows_per_block=20, rows_per_task=rows_per_task)
    (w1, b1), (w2, b2), (w3, b3) = R.initial_layers(6, (5, 4))
    for _ in range(4):
        h1 = np.maximum(x @ w1 + b1, 0)
        h2 = np.maximum(h1 @ w2 + b2, 0)
        o = 1 / (1 + np.exp(-(h2 @ w3 + b3)))
        d3 = (2 * (o[:, 0] - y) / 50)[:, None] * o * (1 - o)
        d2 = (d3 @ w3.T) * (h2 > 0)
        d1 = (d2 @ w2.T) * (h1 > 0)
        w3, b3 = w3 - 0.1 * h2.T @ d3, b3 - 0.1 * d3.sum(0)
        w2, b2 = w2 - 0.1 * h1.T @ d2, b2 - 0.1 * d2.sum(0)
        w1, b1 = w1 - 0.1 * x.T @ d1, b1 - 0.1 * d1.sum(0)
    for (gw, gb), (w, b) in zip(got, ((w1, b1), (w2, b2), (w3, b3))):
        assert np.allclose(gw, w) and np.allclose(gb, b)


def test_too_few_rows_and_wrong_width(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.5), ([2.0, 1.0], 0.4)], ["x", "y"])
    assert R.train_layers(df, "x", "y", epochs=1) is None
    model = R.save_model(spark, R.initial_layers(6, (3,)))
    pairs = spark.createDataFrame([(1, [0.1, 0.2], [0.3, 0.4], "a_vocals", 0), (2, [0.1], [0.3], "a_vocals", 0)],
                                  "pair_id long, emb_a array<double>, emb_b array<double>, direction string, key_shift int")
    got = {r.pair_id: r.quality for r in R.predict_quality(model, pairs).collect()}
    assert got[2] == 0.5 and 0 < got[1] < 1 and got[1] != 0.5


def test_an_epoch_is_one_job(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=(50, 6)).tolist(), "y": rng.random(50)})).persist()

    def jobs(epochs, group):
        spark.sparkContext.setJobGroup(group, group)
        R.train_layers(df, "x", "y", hidden=(5, 4), epochs=epochs, rows_per_block=5, rows_per_task=10)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    jobs(1, "epochs-first")
    assert jobs(4, "epochs-more") - jobs(1, "epochs-few") == 3
    df.unpersist()


def test_equal_times_give_the_same_rating_in_any_order(spark):
    rows = [(1, "t", 3), (1, "t", 5), (1, "s", 4)]
    got = [[tuple(r) for r in R.latest_ratings(spark.createDataFrame(x, "mix_id long, rated_at string, rating int").coalesce(1)).collect()] for x in (rows, rows[::-1])]
    assert got == [[(1, "t", 5)]] * 2


def test_few_neighbors_do_not_shuffle_the_mixes(spark):
    mixes = spark.range(200_000).select(F.col("id").alias("mix_id"), F.lit(0).alias("song_a"), F.lit(1).alias("song_b"), (F.col("id") % 5).alias("rating"))
    # as after a search, whose size no plan knows
    near = spark.range(10).select(F.col("id").alias("pair_id"), F.col("id").alias("mix_id"), F.lit(1.0).alias("similarity")).mapInPandas(
        lambda batches: batches, "pair_id long, mix_id long, similarity double").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        found = R.rated_neighbors(near, mixes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert found.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_half_a_key_goes_to_the_even_one_in_any_order(spark):
    """Six shifts that average -2.5 with weights whose sums are off by a last digit in some orders."""
    rng = np.random.default_rng(1)
    rows = []
    for pair in range(300):
        for shift, weight in zip((-4, -1, -5, 0, -3, -2), np.repeat(rng.random(3), 2), strict=True):
            rows.append((pair, float(weight), 5, "a_vocals", shift, 0.1, 0.1, 0.3, -18.0))
    rng.shuffle(rows)
    schema = "pair_id long, similarity double, rating int, direction string, key_shift int, vox_rms double, inst_rms double, duck_depth double, comp_threshold double"
    rows = [(int(p), float(s), int(r), d, int(k), *map(float, more)) for p, s, r, d, k, *more in rows]
    got = R.weighted_suggestion(spark.createDataFrame(rows, schema)).select("key_shift").distinct().collect()
    assert [r.key_shift for r in got] == [-2]


@pytest.mark.parametrize(("rows_per_task", "songs"), [(1000, 100), (5, 100), (5, 4)])
def test_training_from_ids_equals_training_from_vectors(spark, monkeypatch, rows_per_task, songs):
    """Two widths that add up to the same, mixes without a vector, one mix of another width."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(R, "SONGS", songs)
    emb = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=(3, 5)[i % 2])] if i != 13 else None) for i in range(14)], "song_id long, embedding array<float>")
    rows = [(m, *[(2 * int(a), 2 * int(b) + 1), (2 * int(a) + 1, 2 * int(b))][m % 2], ["a_vocals", "b_vocals", None][m % 3], [None, 2, -5][m % 3], 1 + m % 5)
            for m, (a, b) in enumerate(rng.integers(0, 7, size=(60, 2)))] + [(99, 0, 2, "a_vocals", 1, 5), (98, 0, 77, "a_vocals", 1, 5)]
    rated = spark.createDataFrame(rows, "mix_id long, song_a long, song_b long, direction string, key_shift int, rating int")
    e = lambda s: emb.select(F.col("song_id").alias(f"song_{s}"), F.col("embedding").alias(f"emb_{s}"))
    read = lambda m: np.concatenate([np.concatenate([np.ravel(r["W"]), r["b"]]) for r in sorted(m.collect(), key=lambda r: r["layer"])])
    want = read(R.train_quality(rated.join(e("a"), "song_a").join(e("b"), "song_b"), (5, 4), 6, 0.1))
    written = []
    keep = R.materialize
    monkeypatch.setattr(R, "materialize", lambda d, name: written.append(keep(d, name)) or written[-1])
    got = read(R.train_mixes(rated, emb, (5, 4), 6, 0.1, rows_per_block=7, rows_per_task=rows_per_task))
    assert got == pytest.approx(want, abs=1e-12)
    # no table that has a row per mix has vectors
    assert not [c for d in written if "mix_id" in d.columns for c, kind in d.dtypes if kind.startswith("array")]


def test_cells_of_training_mixes_share_no_first_songs_but_at_their_edges(spark, monkeypatch):
    """Vectors are read anew in every epoch, so a first song's lies in one cell, and in two where a cell ends in its mixes."""
    rng = np.random.default_rng(4)
    emb = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "song_id long, embedding array<float>")
    rows = [(m, int(a), int(b), "a_vocals", 0, 1 + m % 5) for m, (a, b) in enumerate(rng.integers(0, 40, size=(600, 2)))]
    rows += [(600 + m, 7, m % 40, "b_vocals", 0, 3) for m in range(600)]  # one song of half the mixes is shared out
    rated = spark.createDataFrame(rows, "mix_id long, song_a long, song_b long, direction string, key_shift int, rating int")
    held = []
    monkeypatch.setattr(R, "_descend", lambda blocks, gradient, layers, *_: held.extend(blocks.collect()) or layers)
    R.train_mixes(rated, emb, rows_per_task=10)
    first, mixes = [len(block[0]) for block in held], [len(block[-1]) for block in held]
    assert len(held) > 1 and sum(first) <= 40 + len(held) - 1
    assert sum(mixes) == 1200 and max(mixes) < 2 * 1200 / len(held)


def test_training_from_too_few_ids(spark):
    emb = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "song_id long, embedding array<float>")
    rated = spark.createDataFrame([(m, 1, 2, "a_vocals", 0, 3) for m in range(2)], "mix_id long, song_a long, song_b long, direction string, key_shift int, rating int")
    assert R.train_mixes(rated, emb).count() == 0
