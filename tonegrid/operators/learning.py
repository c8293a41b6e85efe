"""Learning from ratings: rated-mix tables, parameter suggestions, a small regressor."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid import constants as K
from tonegrid.functions.scalars import clamp_rating
from tonegrid.operators.ordered import argmax_first
from tonegrid.operators.two_part import nearest_pairs
from tonegrid.session import fresh, materialize

# ---- ratings ------------------------------------------------------------------------------------

def latest_ratings(ratings: DataFrame, order: Sequence[str] = ("rated_at",)) -> DataFrame:
    """Last rating per mix. A map-side aggregate, so a much-rated mix does not gather anywhere; every column travels once."""
    rest = [c for c in ratings.columns if c != "mix_id"]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return ratings.groupBy("mix_id").agg(last.alias("_r")).select("mix_id", *[f"_r.{c}" for c in rest])


def apply_ratings(ratings: DataFrame, params: DataFrame, order: Sequence[str] = ("rated_at",)) -> tuple[DataFrame, DataFrame]:
    """(rated mixes with their parameters and clamped rating, ratings for unknown mixes)."""
    rejects = ratings.join(params.select("mix_id"), "mix_id", "left_anti")
    latest = latest_ratings(ratings, order).withColumn("rating", clamp_rating(F.col("rating")))
    return latest.join(params, "mix_id"), rejects


def ratings_count(ratings: DataFrame) -> DataFrame:
    """One row: n, can_train, can_retrain."""
    n = F.count("rating")
    return ratings.agg(n.alias("n"), (n >= K.MIN_RATINGS_TO_TRAIN).alias("can_train"), (n >= K.MIN_RATINGS_TO_RETRAIN).alias("can_retrain"))


def dominant_width(emb: DataFrame, embedding: str, order: str) -> DataFrame:
    """Rows whose vector has the most common width; on a tie the width seen first."""
    by = emb.groupBy(F.size(embedding).alias("_w")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = by.agg(F.max_by("_w", F.struct(F.col("_n"), -F.col("_first"))).alias("_w"))
    return emb.withColumn("_w", F.size(embedding)).join(best, "_w", "left_semi").drop("_w")


def pair_history(rated: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rated mixes of exactly these pairs, in either order (direction flipped): pair_id, direction, rating, mix_id."""
    r = rated.select("song_a", "song_b", "direction", "rating", "mix_id")
    flip = F.when(F.col("direction") == "a_vocals", "b_vocals").otherwise("a_vocals")
    swapped = r.where(F.col("song_a") != F.col("song_b")).select(
        F.col("song_b").alias("song_a"), F.col("song_a").alias("song_b"), flip.alias("direction"), "rating", "mix_id")
    return pairs.select("pair_id", "song_a", "song_b").join(r.unionByName(swapped), ["song_a", "song_b"]).drop("song_a", "song_b")


def best_direction_by_rating(rated: DataFrame, pairs: DataFrame) -> DataFrame:
    """Direction with the best mean rating per pair; on a tie the one seen first: pair_id, direction, mean_rating.

    Ratings are summed per songs and direction before pairs meet them, so a pair rated and asked for many times is a few rows.
    """
    flip = F.when(F.col("direction") == "a_vocals", "b_vocals").otherwise("a_vocals")
    sums = rated.groupBy("song_a", "song_b", "direction").agg(F.sum("rating").alias("_s"), F.count("rating").alias("_n"), F.min("mix_id").alias("_first"))
    swapped = sums.where(F.col("song_a") != F.col("song_b")).select(F.col("song_b").alias("song_a"), F.col("song_a").alias("song_b"), flip.alias("direction"), "_s", "_n", "_first")
    by = sums.unionByName(swapped).groupBy("song_a", "song_b", "direction").agg((F.sum("_s") / F.sum("_n")).alias("_m"), F.min("_first").alias("_first"))
    best = argmax_first(by, ["song_a", "song_b"], F.round("_m", 12), F.col("_first"), {"direction": F.col("direction"), "mean_rating": F.col("_m")})
    return pairs.select("pair_id", "song_a", "song_b").join(best, ["song_a", "song_b"]).select("pair_id", "direction", "mean_rating")


def nearest_rated(pairs: DataFrame, rated: DataFrame, emb: DataFrame, k: int = 5) -> DataFrame:
    """The k rated mixes most similar to each pair: pair_id, mix_id, similarity.

    Both carry song_a and song_b, whose vectors are in ``emb`` (song_id, embedding); only mixes with the same two
    widths are comparable. A mix travels as its ids, never as its vectors.
    """
    ids = lambda d, key: d.select(F.col(key).cast("bigint").alias("id"), "song_a", "song_b")
    m = nearest_pairs(ids(pairs, "pair_id"), ids(rated, "mix_id"), emb, k)
    return m.select(F.col("id").alias("pair_id"), F.col("match").alias("mix_id"), F.col("score").alias("similarity"))


def rated_neighbors(near: DataFrame, rated: DataFrame) -> DataFrame:
    """Neighbours with rating and parameters of their mixes. They are few and written first, so that the mixes need not be shuffled for them."""
    return materialize(near, "neighbors").join(rated.drop("song_a", "song_b"), "mix_id")


def weighted_suggestion(neighbors: DataFrame) -> DataFrame:
    """Parameters averaged over neighbours by similarity times rating; pairs without weight drop out.

    ``neighbors``: pair_id, similarity, rating, direction and the parameters.
    """
    w = F.greatest(F.col("similarity"), F.lit(0.0)) * (F.col("rating") / 5.0)
    means = [(F.sum(w * F.coalesce(F.col(p).cast("double"), F.lit(default))) / F.sum(w)).alias(p) for p, default in K.PARAM_DEFAULTS.items()]
    vote = lambda d: F.sum(F.when(F.coalesce("direction", F.lit("a_vocals")) == d, w).otherwise(0.0))
    s = neighbors.groupBy("pair_id").agg(F.sum(w).alias("_w"), *means, vote("a_vocals").alias("_a"), vote("b_vocals").alias("_b"))
    s = s.where(F.col("_w") > 1e-6)
    # halves are recognised whatever the order of summation
    return s.select("pair_id", F.when(F.round("_b", 12) > F.round("_a", 12), "b_vocals").otherwise("a_vocals").alias("direction"), "vox_rms", "inst_rms",
                    F.bround(F.round("key_shift", 9)).cast("int").alias("key_shift"), "duck_depth", "comp_threshold")


def suggest_params(pairs: DataFrame, rated: DataFrame, emb: DataFrame, k: int = 5) -> DataFrame:
    """Suggested parameters per pair: from similar rated mixes, else the direction of the pair's own history.

    ``pairs``: pair_id, song_a, song_b; ``rated``: rated mixes with parameters; ``emb``: song_id, embedding. Fewer than
    three ratings suggest nothing.
    """
    rated = materialize(rated, "rated")
    enough = ratings_count(rated).where("can_train").select(F.lit(1).alias("_on"))
    near = nearest_rated(pairs, rated, emb, k)
    by_vector = materialize(weighted_suggestion(rated_neighbors(near, rated)), "suggested")
    own = best_direction_by_rating(rated, pairs).join(by_vector, "pair_id", "left_anti").select("pair_id", "direction")
    both = by_vector.unionByName(own, allowMissingColumns=True)
    return both.withColumn("_on", F.lit(1)).join(enough, "_on", "left_semi").drop("_on")


# ---- regressor ----------------------------------------------------------------------------------

def initial_layers(width: int, hidden: Sequence[int] = (64, 32), seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """He-scaled normal weights and zero biases, drawn layer by layer."""
    rng, sizes = np.random.RandomState(seed), [width, *hidden, 1]
    return [(rng.randn(i, o).astype(np.float32).astype(np.float64) * np.sqrt(2.0 / i), np.zeros(o)) for i, o in zip(sizes, sizes[1:])]


def _forward(layers, x):
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(1.0 / (1.0 + np.exp(-z)) if i == len(layers) - 1 else np.maximum(z, 0.0))
    return acts


def _gradient(layers, x, y, n):
    """Gradient of the mean squared error over n rows in all, as one flat vector."""
    acts = _forward(layers, x)
    out = acts[-1][:, 0]
    delta = (2.0 * (out - y) / n)[:, None] * acts[-1] * (1.0 - acts[-1])
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(acts[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * (acts[i] > 0)
    return np.concatenate(parts[::-1])


def _step(layers, flat, lr):
    at, out = 0, []
    for w, b in layers:
        gw, gb = flat[at:at + w.size].reshape(w.shape), flat[at + w.size:at + w.size + b.size]
        at += w.size + b.size
        out.append((w - lr * gw, b - lr * gb))
    return out


#: Gradients of one epoch that the driver adds up itself; more are added up in a tree first.
SUMS = 64
_SUM = T.StructType([T.StructField("g", T.BinaryType())])


def train_layers(features: DataFrame, x: str, y: str, hidden: Sequence[int] = (64, 32), epochs: int = 500, lr: float = 0.01, seed: int = 42,
                 layers=None, rows_per_block: int = 1 << 16, rows_per_task: int = 1 << 14) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Full-batch gradient descent; None with fewer than three rows.

    Up to ``rows_per_task`` rows are one task's work: it holds them and takes all steps without a job per epoch. More rows are packed once into blocks that stay cached on the executors; every epoch is one job of plain tasks
    that sends the weights out and adds up one gradient per partition. At most ``SUMS`` gradients, each of the size of the model, reach the driver.
    """
    d = features.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull())
    head = d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w")).collect()[0]
    n, width = head["n"], head["w"]
    if n < K.MIN_RATINGS_TO_TRAIN:
        return None
    # every core gets as many blocks as any other
    cores = features.sparkSession.sparkContext.defaultParallelism
    parts = -(-n // (rows_per_block * cores)) * cores
    packed = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])

    def pack(batches):
        for pdf in batches:
            m = np.array(pdf["x"].tolist(), dtype=np.float64)
            yield pd.DataFrame({"x": [m.tobytes()], "y": [pdf["y"].to_numpy(dtype=np.float64).tobytes()]})

    layers = layers or initial_layers(width, hidden, seed)

    def all_epochs(batches):
        held = [(np.array(pdf["x"].tolist(), dtype=np.float64), pdf["y"].to_numpy(dtype=np.float64)) for pdf in batches]
        current = layers
        for _ in range(epochs):
            current = _step(current, sum(_gradient(current, bx, by, n) for bx, by in held), lr)
        yield pd.DataFrame({"g": [np.concatenate([np.concatenate([w.ravel(), b]) for w, b in current]).tobytes()]})

    if n <= rows_per_task:
        flat = np.frombuffer(d.coalesce(1).mapInPandas(all_epochs, _SUM).collect()[0]["g"])
        # a step of minus one from zero is the weights themselves
        return _step([(np.zeros_like(w), np.zeros_like(b)) for w, b in layers], flat, -1.0)
    blocks = d.repartition(parts).mapInPandas(pack, packed).rdd.map(lambda r: (bytes(r["x"]), bytes(r["y"]))).persist(StorageLevel.MEMORY_AND_DISK)

    def gradient(current, block):
        yy = np.frombuffer(block[1])
        return _gradient(current, np.frombuffer(block[0]).reshape(len(yy), -1), yy, n)

    return _descend(blocks, gradient, layers, epochs, lr, parts)


def _descend(blocks, gradient, layers, epochs: int, lr: float, parts: int):
    """All epochs over kept blocks: every epoch is one job that sends the weights out and adds up one gradient per partition."""
    try:
        for _ in range(epochs):
            current = layers

            def summed(held):
                total = 0.0
                for block in held:
                    total = total + gradient(current, block)
                if not np.isscalar(total):
                    yield total

            sums = blocks.mapPartitions(summed)
            layers = _step(layers, sums.treeReduce(np.add) if parts > SUMS else sum(sums.collect()), lr)
    finally:
        blocks.unpersist()
    return layers


def _mix_gradient(layers, block, n):
    """As ``_gradient`` for mixes of two songs: a song's share of the first layer is taken once per block and not per mix.

    ``block``: vectors of the first and second songs, the places of each mix in them (ascending in the first), flag and shift, target.
    """
    ea, eb, ia, ib, more, y = block
    (w, b), rest = layers[0], layers[1:]
    wa, wb = ea.shape[1], eb.shape[1]
    ea, eb = ea.astype(np.float64, copy=False), eb.astype(np.float64, copy=False)
    at_a, at_b = ea @ w[:wa] + b, eb @ w[wa:wa + wb]
    of_a, of_b, of_more, of_b1, others = np.zeros_like(at_a), 0.0, 0.0, 0.0, 0.0
    for lo in range(0, len(y), SLICE):
        a, c, own = ia[lo:lo + SLICE], ib[lo:lo + SLICE], more[lo:lo + SLICE]
        z = at_a[a]
        z += at_b[c]
        z += own @ w[wa + wb:]
        acts = _forward(rest, np.maximum(z, 0.0, out=z))
        out = acts[-1][:, 0]
        delta = (2.0 * (out - y[lo:lo + SLICE]) / n)[:, None] * acts[-1] * (1.0 - acts[-1])
        parts = []
        for i in range(len(rest) - 1, -1, -1):
            parts.append(np.concatenate([(acts[i].T @ delta).ravel(), delta.sum(axis=0)]))
            delta = delta @ rest[i][0].T
            delta *= acts[i] > 0
        others = others + np.concatenate(parts[::-1])
        of_more, of_b1 = of_more + own.T @ delta, of_b1 + delta.sum(axis=0)
        # first songs lie together, so they are summed up as runs; second songs seldom repeat in a slice
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        of_a[a[first]] += np.add.reduceat(delta, first, axis=0)
        of_b = of_b + eb[c].T @ delta
    return np.concatenate([(ea.T @ of_a).ravel(), of_b.ravel(), of_more.ravel(), of_b1, others])


#: Mixes whose activations are held at once, so that they stay in a core's cache.
SLICE = 1 << 10
#: Second songs that a cell of training mixes meets at most (about), two such numbers at an edge.
SONGS = 1 << 17


def train_mixes(rated: DataFrame, emb: DataFrame, hidden: Sequence[int] = (64, 32), epochs: int = 500, lr: float = 0.01, seed: int = 42,
                rows_per_block: int = 1 << 19, rows_per_task: int = 1 << 14) -> DataFrame:
    """The model of ``train_quality`` from ids: a mix travels as its two songs, never as its vectors.

    ``rated``: mix_id, song_a, song_b, direction, key_shift, rating; ``emb``: song_id, embedding. Mixes are dealt by ranges of their first song into
    cells, as many for every core, of about ``rows_per_block`` mixes at most; a cell holds the vectors of its songs once. Mixes of the most common width are
    trained on; on a tie that of the lowest mix id. The driver holds one count per combination of widths.
    """
    spark = rated.sparkSession
    songs = emb.where(F.col("embedding").isNotNull()).select("song_id", F.col("embedding").alias("e"), F.size("embedding").alias("w"))
    place = songs.select("song_id", "w", F.pmod(F.xxhash64("song_id"), F.lit(max(1, -(-songs.count() // SONGS)))).alias("h"))
    side = lambda s: place.select(*[F.col(c).alias({"song_id": f"song_{s}"}.get(c, c + s)) for c in place.columns])
    flag = F.when(F.col("direction") == "a_vocals", 1.0).otherwise(0.0)
    mixes = rated.select("mix_id", "song_a", "song_b", flag.alias("flag"), (F.coalesce("key_shift", F.lit(0)) / F.lit(6.0)).alias("shift"), (F.col("rating") / 5.0).alias("y"))
    mixes = materialize(mixes.join(side("a").drop("ha"), "song_a").join(side("b"), "song_b"), "training-mixes")
    widths = mixes.groupBy((F.col("wa") + F.col("wb")).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("mix_id").alias("first"))
    width, n, _ = max(map(tuple, widths.collect()), key=lambda r: (r[1], -r[2]), default=(0, 0, 0))
    if n < K.MIN_RATINGS_TO_TRAIN:
        return save_model(spark, None)
    cores = spark.sparkContext.defaultParallelism
    parts = -(-n // (rows_per_block * cores)) * cores if n > rows_per_task else 1
    # a range ends inside a song that many mixes share
    cells = mixes.where(F.col("wa") + F.col("wb") == width).repartitionByRange(parts, "hb", "song_a", "mix_id")
    cells = materialize(cells.select(F.spark_partition_id().alias("cell"), "mix_id", "song_a", "song_b", "wa", "wb", "flag", "shift", "y"), "training-cells")
    used = cells.select("cell", F.explode(F.array("song_a", "song_b")).alias("song_id")).distinct()
    vectors = used.join(songs, "song_id").select("cell", "song_id", "w", "e")
    precision = np.float32 if emb.schema["embedding"].dataType.elementType == T.FloatType() else np.float64

    def pack(held: pa.Table, met: pa.Table) -> pa.Table:
        out = []
        tables = {}
        for w in met.column("w").unique().to_pylist():
            at = met.filter(pc.equal(met.column("w"), w)).sort_by("song_id")
            vecs = at.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(precision, copy=False)
            tables[w] = (at.column("song_id").to_numpy(), vecs.reshape(len(at), w))
        for wa in held.column("wa").unique().to_pylist():
            rows = held.filter(pc.equal(held.column("wa"), wa)).sort_by([("song_a", "ascending"), ("mix_id", "ascending")])
            block = {"wa": wa}
            for s, w in (("a", wa), ("b", width - wa)):
                ids, vecs = tables[w]
                row, places = np.unique(np.searchsorted(ids, rows.column(f"song_{s}").to_numpy()), return_inverse=True)
                block |= {f"e{s}": vecs[row].tobytes(), f"i{s}": places.astype(np.int32).tobytes()}
            block["more"] = np.stack([rows.column("flag").to_numpy(), rows.column("shift").to_numpy()], axis=1).tobytes()
            block["y"] = rows.column("y").to_numpy().tobytes()
            out.append({"cell": rows.column("cell")[0].as_py()} | block)
        return pa.Table.from_pylist(out, pa.schema([("cell", pa.int32()), ("wa", pa.int32()), *[(c, pa.binary()) for c in ("ea", "ia", "eb", "ib", "more", "y")]]))

    met = cells.groupBy("cell").cogroup(fresh(vectors).groupBy("cell"))
    blocks = met.applyInArrow(pack, "cell int, wa int, ea binary, ia binary, eb binary, ib binary, more binary, y binary").rdd

    def opened(r):
        read = lambda c, kind, w: np.frombuffer(bytes(r[c]), kind).reshape(-1, w)
        return (read("ea", precision, r["wa"]), read("eb", precision, width - r["wa"]), read("ia", np.int32, 1)[:, 0], read("ib", np.int32, 1)[:, 0],
                read("more", np.float64, 2), read("y", np.float64, 1)[:, 0])

    blocks = blocks.map(lambda r: (r["cell"], opened(r))).partitionBy(parts, int).values()
    layers = initial_layers(width + 2, hidden, seed)
    if parts > 1:
        return save_model(spark, _descend(blocks.persist(StorageLevel.MEMORY_AND_DISK), lambda current, block: _mix_gradient(current, block, n), layers, epochs, lr, parts))

    def all_epochs(held):
        held, current = list(held), layers
        for _ in range(epochs):
            current = _step(current, sum(_mix_gradient(current, b, n) for b in held), lr)
        yield current

    return save_model(spark, blocks.mapPartitions(all_epochs).collect()[0])


MODEL = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("W", T.ArrayType(T.ArrayType(T.DoubleType()))),
                      T.StructField("b", T.ArrayType(T.DoubleType()))])


def save_model(spark, layers) -> DataFrame:
    """Model table: layer, W, b."""
    return spark.createDataFrame([(i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(layers or [])], MODEL)


def load_model(model: DataFrame):
    """Layers of a model table (a few rows), or None."""
    rows = sorted(model.collect(), key=lambda r: r["layer"])
    return [(np.array(r["W"]), np.array(r["b"])) for r in rows] or None


def train_quality(rated: DataFrame, hidden: Sequence[int] = (64, 32), epochs: int = 500, lr: float = 0.01, seed: int = 42) -> DataFrame:
    """Quality model from rated mixes (emb_a, emb_b, direction, key_shift, rating, mix_id): target rating/5."""
    from tonegrid.functions.arrays import feature_vector

    f = rated.where(F.col("emb_a").isNotNull() & F.col("emb_b").isNotNull()).select(
        "mix_id", feature_vector(F.col("emb_a"), F.col("emb_b"), F.col("direction"), F.coalesce("key_shift", F.lit(0))).alias("x"), (F.col("rating") / 5.0).alias("y"))
    f = materialize(f, "training-rows")
    return save_model(rated.sparkSession, train_layers(dominant_width(f, "x", "mix_id"), "x", "y", hidden, epochs, lr, seed))


def score_vectors(layers, x: Column) -> Column:
    """Model output per feature vector; .5 without model or for another width."""
    if not layers:
        return F.lit(0.5)
    width = layers[0][0].shape[0]

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        return pd.Series(_forward(layers, np.array(v.tolist(), dtype=np.float64))[-1][:, 0])

    zeros = F.array_repeat(F.lit(0.0), width)
    fits = F.size(x) == width
    return F.when(fits, run(F.when(fits, x).otherwise(zeros))).otherwise(F.lit(0.5))


def predict_quality(model: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds quality for pairs with emb_a, emb_b, direction, key_shift."""
    from tonegrid.functions.arrays import feature_vector

    x = feature_vector(F.col("emb_a"), F.col("emb_b"), F.col("direction"), F.col("key_shift"))
    return pairs.withColumn("quality", score_vectors(load_model(model), x))


def predict_directional(model: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds compatibility from vectors and a direction flag (0 for A vocals, 1 for B vocals)."""
    flag = F.when(F.col("direction") == "a_vocals", 0.0).otherwise(1.0)
    x = F.concat(F.col("emb_a").cast("array<double>"), F.col("emb_b").cast("array<double>"), F.array(flag))
    return pairs.withColumn("compatibility", score_vectors(load_model(model), x))


# ---- session chain ------------------------------------------------------------------------------

def session_chain(next_of: DataFrame, starts: DataFrame, count: int, no_repeat: bool = False) -> DataFrame:
    """Follow each start's best next song ``count`` times: start_id, step, song_id.

    ``next_of``: song_id, next_id, score. One join per step serves all starts at once. Chains may come back to
    earlier songs unless ``no_repeat``; that needs the best ``count`` + 1 follow-ups per song, of which a chain can
    have used at most ``count``.
    """
    hop = next_of.where(F.col("next_id").isNotNull()).select("song_id", "next_id", "score")
    at = starts.select(F.col("song_id").alias("start_id"), "song_id", F.array("song_id").alias("seen"))
    steps = []
    for i in range(1, count + 1):
        to = at.join(hop, "song_id")
        if no_repeat:
            to = to.where(~F.array_contains("seen", F.col("next_id")))
        best = F.max_by(F.struct("next_id", "seen"), F.struct(F.col("score"), -F.col("next_id")))
        to = to.groupBy("start_id").agg(best.alias("_b"))
        at = materialize(to.select("start_id", F.col("_b.next_id").alias("song_id"), F.array_append("_b.seen", F.col("_b.next_id")).alias("seen")), "chain")
        steps.append(at.select("start_id", F.lit(i).alias("step"), "song_id"))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out
