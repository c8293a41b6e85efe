"""Exact similarity search over vectors without forming all pairs.

Equal rows are searched once; distinct ones are packed into blocks under balls, and pairs of blocks are searched best first
(see ``balls``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.functions.scalars import parse_key_relative
from tonegrid.operators import balls
from tonegrid.session import materialize


def _representatives(df: DataFrame, features: Sequence[str], keep: int) -> DataFrame:
    """One row per distinct feature tuple with its ``keep`` lowest ids (enough for any top list)."""
    # the hash leads the sort keys, so vectors are compared only when it is equal; one sort serves both windows
    order = Window.partitionBy("_h", *features).orderBy("id")
    few = df.select("id", F.xxhash64(*features).alias("_h"), *features).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    return few.withColumn("ids", F.collect_list("id").over(order.rowsBetween(0, keep - 1))).where(F.col("_r") == 1).select("ids", *features)


def top_matches(queries: DataFrame, base: DataFrame, k: int, extra: Sequence[str] = (),
                score: Callable | None = None, bound: Callable | None = None, skip_same: bool = False,
                global_top: bool = False, block_rows: int = balls.BLOCK_ROWS, trace: list | None = None) -> DataFrame:
    """Best ``k`` base rows per query by vector score: id, match, score.

    Both inputs carry ``id`` (bigint) and ``vec`` (array<double>) plus ``extra`` columns. Only vectors of one width
    meet. ``score(q, b, row, col, dots, least)`` gives the scores of pairs from their dot products and their rows in two frames of
    the ``extra`` columns (default: the dot product; minus infinity is no match; below ``least`` any lower score will do), and ``bound(dots)`` is the highest score
    any pair with at most that dot product may have: only pairs that can reach a list are scored. Scores are
    compared at nine decimals, equal ones go to the lower match id. ``skip_same`` leaves out a row
    matching its own id. With ``global_top`` only pairs that can reach the overall best ``k`` are
    searched and lists may be incomplete below that. ``trace`` gathers the node pairs that were searched.
    """
    features = ["vec", *extra]
    want = k + 1 if skip_same else k
    q = queries.select("id", F.xxhash64(*features).alias("_h"), *features)
    reps = materialize(q.groupBy("_h", *features).agg(F.min("id").alias("rep")), "match-queries")
    asking = balls.pack(reps.drop("_h"), ["rep", *extra], "queries", block_rows)
    packed = balls.pack(_representatives(base, features, want), ["ids", *extra], "base", block_rows)

    def kth(found: DataFrame) -> float:
        other = found.where(F.col("rep") != F.col("match")) if skip_same else found
        best = other.orderBy(F.desc("score")).limit(2 * k).collect()  # 2k rows: a pair may be seen from both ends
        return best[-1]["score"] if len(best) == 2 * k else float("-inf")

    found = balls.search(asking, packed, want, extra, score or (lambda q, b, row, col, dots, least: dots), bound or (lambda dot: dot), kth if global_top else None, trace)
    per_query = q.join(reps, ["_h", *features]).select("id", "rep").join(found, "rep").drop("rep")
    if skip_same:
        per_query = per_query.where(F.col("id") != F.col("match"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "match")
    return per_query.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("id", "match", "score")


def _vectors(emb: DataFrame, song_id: str, embedding: str) -> DataFrame:
    return emb.where(F.col(embedding).isNotNull()).select(
        F.col(song_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))


def top_pairs(emb: DataFrame, n: int, song_id: str = "song_id", embedding: str = "embedding", **opts) -> DataFrame:
    """The n most similar pairs: song_a < song_b, similarity; ties in id order."""
    v = _vectors(emb, song_id, embedding)
    m = top_matches(v, v, n, skip_same=True, global_top=True, **opts)
    pairs = m.where(F.col("id") < F.col("match"))
    return top_n(pairs.select(F.col("id").alias("song_a"), F.col("match").alias("song_b"), F.col("score").alias("similarity")),
                 [F.desc("similarity"), F.col("song_a"), F.col("song_b")], n)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_match(emb: DataFrame, song_id: str = "song_id", embedding: str = "embedding", ids: DataFrame | None = None,
               **opts) -> DataFrame:
    """Most similar other song per song; null without embedding or partner."""
    v = _vectors(emb, song_id, embedding)
    asked = emb.select(F.col(song_id).cast("bigint").alias("id")) if ids is None else ids.select(
        F.col(song_id).cast("bigint").alias("id"))
    m = top_matches(v.join(asked, "id", "left_semi"), v, 1, skip_same=True, **opts)
    return asked.join(m, "id", "left").select(F.col("id").alias(song_id), F.col("match").alias("match_id"),
                                              F.col("score").alias("similarity"))


def _tempo_scores(ta: np.ndarray, tb: np.ndarray) -> np.ndarray:
    hi, low = np.maximum(ta, tb), np.minimum(ta, tb)
    r = hi / np.maximum(low, 1.0)
    a, b, double, _ = K.TEMPO_DOUBLE
    steps = [(r < below, s) for below, s, _ in K.TEMPO_STEPS]
    steps.append(((r > a) & (r < b), double))
    return np.select([c for c, _ in steps], [s for _, s in steps], K.TEMPO_FAR[0])


def _chroma_scores(a: pd.Series, b: pd.Series, row: np.ndarray, col: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    """Rotation-invariant correlation score of pairs of rows where both sides have twelve values."""
    def units(s, used):
        used, at = np.unique(used, return_inverse=True)
        ok = np.array([v is not None and len(v) == 12 for v in s.iloc[used]], dtype=bool)
        m = np.full((len(used), 12), np.nan)
        if ok.any():
            m[ok] = np.array([v for v, o in zip(s.iloc[used], ok) if o], dtype=np.float64)
        m = m - m.mean(axis=1, keepdims=True)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(size > 0, m / np.where(size > 0, size, 1.0), np.nan), ok, at

    (ua, ok_a, at_a), (ub, ok_b, at_b) = units(a, row), units(b, col)
    out = fallback.copy()
    both = np.flatnonzero(ok_a[at_a] & ok_b[at_b])
    left, right = ua[at_a[both]], ub[at_b[both]]
    best = np.max([(left * np.roll(right, s, axis=1)).sum(axis=1) for s in range(12)], axis=0)
    out[both] = np.nan_to_num(np.clip((best + 0.5) / 1.5, 0.0, 1.0), nan=0.0)
    return out


def next_song(songs: DataFrame, emb: DataFrame, ids: DataFrame | None = None, k: int = 1, **opts) -> DataFrame:
    """Best follow-up (or best k) per song: half embedding similarity, .3 key and .2 tempo compatibility.

    ``songs`` has song_id, tempo, key and optionally key_chroma. A song without tempo and key counts as
    not comparable (+.25 flat), one without embedding or with one of another width gets no similarity part.
    """
    chroma = F.col("key_chroma") if "key_chroma" in songs.columns else F.array().cast("array<double>")
    widths = sorted(r["w"] for r in emb.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("w")).distinct().collect()) or [1]
    s = songs.select(F.col("song_id").cast("bigint").alias("id"), "tempo", "key", F.coalesce(chroma.cast("array<double>"), F.array().cast("array<double>")).alias("chroma"))
    s = s.join(emb.select(F.col("song_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("e")), "id", "left")
    # each width has places of its own, so that products between widths are zero
    own = F.concat(*[F.when(F.size("e") == w, F.col("e")).otherwise(F.array_repeat(F.lit(0.0), w)) for w in widths])
    s = s.select("id", own.alias("vec"),
                 F.coalesce(F.col("tempo").cast("double"), F.lit(120.0)).alias("tempo"),
                 parse_key_relative(F.coalesce("key", F.lit("C major"))).alias("root"),
                 (F.col("tempo").isNotNull() | F.col("key").isNotNull()).alias("known"), "chroma")
    table = np.array([K.INTERVAL_SCORES[i] for i in range(12)])

    def score(q, b, row, col, dots, least):
        of = lambda c, at: (q[c].to_numpy()[row[at]], b[c].to_numpy()[col[at]])
        known, also = of("known", slice(None))
        both = known & also
        out = 0.5 * dots + np.where(both, 0.2 * _tempo_scores(*of("tempo", slice(None))), 0.25)
        # keys are compared where the best key score would do
        near = np.flatnonzero(both & (out + 0.3 >= least - 1e-9))
        root, other = of("root", near)
        out[near] += 0.3 * _chroma_scores(q["chroma"], b["chroma"], row[near], col[near], table[np.abs(root - other) % 12])
        return out

    asked = s if ids is None else s.join(ids.select(F.col("song_id").cast("bigint").alias("id")), "id", "left_semi")
    m = top_matches(asked, s, k, ["tempo", "root", "known", "chroma"], score, lambda dot: 0.5 * dot + 0.5, skip_same=True, **opts)
    return asked.select("id").join(m, "id", "left").select(
        F.col("id").alias("song_id"), F.col("match").alias("next_id"), "score")
