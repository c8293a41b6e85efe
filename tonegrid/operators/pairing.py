"""Song and section pair scoring, alignment and agreement measures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.functions.arrays import chroma_compatibility, cosine
from tonegrid.functions.scalars import clip, key_interval_score, tempo_score, tempo_strategy
from tonegrid.operators.intervals import interval_join
from tonegrid.operators.ordered import argmax_first, carry, dense_index, halo_window
from tonegrid.session import materialize


def attach_songs(pairs: DataFrame, songs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Song columns for both sides as ``a_*`` and ``b_*``; pairs with an unknown song drop out."""
    for side in ("a", "b"):
        pairs = pairs.join(songs.select(F.col("song_id").alias(f"song_{side}"),
                                        *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"song_{side}")
    return pairs


def pair_compatibility(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """Overall and partial compatibility per pair.

    ``songs``: song_id, tempo, key, key_chroma, overall_energy, n_sections. Timbre is taken from the key
    profile and the structure score does not enter the overall score.
    """
    d = attach_songs(pairs, songs, ["tempo", "key", "key_chroma", "overall_energy", "n_sections"])
    both = lambda name, default: [F.coalesce(f"{s}_{name}", F.lit(default)) for s in ("a", "b")]
    tempo = tempo_score(*both("tempo", 120.0))["score"]
    ca, cb = F.col("a_key_chroma"), F.col("b_key_chroma")
    key = chroma_compatibility(ca, cb, key_interval_score(*both("key", "C major"))["score"])
    same = (F.size(ca) > 0) & (F.size(ca) == F.size(cb))
    timbre = F.when(same, clip((cosine(ca, cb) + 1) / 2, 0, 1)).otherwise(F.lit(0.6))
    ea, eb = both("overall_energy", 0.5)
    span = clip(1.0 - F.abs(ea - eb), 0, 1)
    na, nb = [F.greatest(c, F.lit(1)) for c in both("n_sections", 0)]
    structure = clip(1.0 - F.abs(na - nb) / F.greatest(na, nb), 0, 1)
    d = (d.withColumn("tempo_compatibility", tempo).withColumn("key_compatibility", F.coalesce(key, key_interval_score(
        *both("key", "C major"))["score"])).withColumn("timbre_compatibility", F.coalesce(timbre, F.lit(0.6)))
         .withColumn("range_compatibility", span).withColumn("structure_compatibility", structure))
    t, k = F.col("tempo_compatibility"), F.col("key_compatibility")
    overall = clip(t * 0.35 + k * 0.35 + F.col("timbre_compatibility") * 0.15 + F.col("range_compatibility") * 0.10 + 0.05, 0, 1)
    return d.withColumn("overall_score", overall).withColumn("vocal_blend_score", clip(k * 0.6 + t * 0.4, 0, 1)).drop(
        *[f"{s}_{c}" for s in ("a", "b") for c in ("tempo", "key", "key_chroma", "overall_energy", "n_sections")])


def section_type_bonus(df: DataFrame, vox: str, beat: str) -> DataFrame:
    """Adds type_bonus from the fixed six-row table (a literal map, no join needed)."""
    table = F.create_map(*[x for v, b, s in K.SECTION_BONUS for x in (F.lit(f"{v}|{b}"), F.lit(s))])
    return df.withColumn("type_bonus", F.coalesce(F.try_element_at(table, F.concat_ws("|", vox, beat)), F.lit(0.0)))


def section_pairings(pairs: DataFrame, sections: DataFrame, key_compat: DataFrame) -> DataFrame:
    """Every section of A with every section of B in both directions, scored.

    The result itself is the combination of both section lists; pairing goes by song id with one row per
    (pair, section of A), so a long list spreads over its sections. ``key_compat``: pair_id, key_score.
    """
    cols = ["section_idx", "energy", "spectral_centroid", "has_vocals", "classification"]
    side = lambda s: sections.select(F.col("song_id").alias(f"song_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    d = pairs.join(key_compat, "pair_id").join(side("a"), "song_a").join(side("b"), "song_b")
    d = d.withColumn("direction", F.explode(F.array(F.lit("a_vocals"), F.lit("b_vocals"))))
    a_sings = F.col("direction") == "a_vocals"
    role = lambda c: (F.when(a_sings, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")),
                      F.when(a_sings, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    (vox_e, beat_e), (vox_v, beat_v), (vox_t, beat_t) = role("energy"), role("has_vocals"), role("classification")
    fit = F.greatest(F.lit(0.0), 1.0 - F.abs(vox_e - beat_e) * 1.5)
    energy = F.when(beat_e > vox_e, F.least(F.lit(1.0), fit + 0.1)).otherwise(fit)
    roles = (F.when(vox_v & ~beat_v, 1.0).when(vox_v, (0.5 + 0.3) * 0.5).when(~beat_v, 0.5 + 0.2).otherwise(0.5))
    ca, cb = F.col("a_spectral_centroid"), F.col("b_spectral_centroid")
    spectral = F.least(F.lit(1.0), F.abs(ca - cb) / F.greatest(ca, cb, F.lit(1.0)) + 0.3)
    d = (d.withColumn("energy_score", energy).withColumn("role_score", roles).withColumn("spectral_score", spectral)
         .withColumn("_vt", vox_t).withColumn("_bt", beat_t))
    d = section_type_bonus(d, "_vt", "_bt")
    base = F.col("energy_score") * 0.25 + F.col("role_score") * 0.35 + F.col("spectral_score") * 0.15 + F.col("key_score") * 0.25
    return d.select("pair_id", "song_a", "song_b", F.col("a_section_idx").alias("section_a"), F.col("b_section_idx").alias("section_b"),
                    "direction", "energy_score", "role_score", "spectral_score", "key_score",
                    F.least(F.lit(1.0), base + F.col("type_bonus")).alias("overall_score"))


#: Sections of a song that travel as one row.
BLOCK = 512
_SIDE = ["section_idx", "energy", "spectral_centroid", "has_vocals", "classification"]


def _overall(vox: dict, beat: dict, vocal_first: bool, key: float) -> np.ndarray:
    """Overall scores of two blocks of sections, rows by the sections of A; missing values count as in ``section_pairings``."""
    at = (lambda v, b: (v[:, None], b[None, :])) if vocal_first else (lambda v, b: (v[None, :], b[:, None]))
    ve, be = at(vox["energy"], beat["energy"])
    vv, bv = at(vox["has_vocals"], beat["has_vocals"])
    cv, cb = at(vox["spectral_centroid"], beat["spectral_centroid"])
    fit = np.fmax(0.0, 1.0 - np.abs(ve - be) * 1.5)
    energy = np.where(be > ve, np.fmin(1.0, fit + 0.1), fit)
    roles = np.where(vv & ~bv, 1.0, np.where(vv, (0.5 + 0.3) * 0.5, np.where(~bv, 0.5 + 0.2, 0.5)))
    spectral = np.fmin(1.0, np.abs(cv - cb) / np.fmax(np.fmax(cv, cb), 1.0) + 0.3)
    bonus = np.zeros(energy.shape)
    for v, b, s in K.SECTION_BONUS:
        is_v, is_b = at(vox["classification"] == v, beat["classification"] == b)
        bonus[is_v & is_b] = s
    return np.fmin(1.0, energy * 0.25 + roles * 0.35 + spectral * 0.15 + key * 0.25 + bonus)


def pairing_summary(pairs: DataFrame, sections: DataFrame, key_compat: DataFrame, n: int = 10) -> DataFrame:
    """What the pairings of two songs come to, without a row per pairing: pair_id, song_a, song_b, the mean score by vocal
    role (direction_score_a, direction_score_b) and the ``n`` best pairings of either role (top_a, top_b).

    Sections travel as blocks of up to ``BLOCK`` of a song. Two blocks are one outer product in a task, which gives back two
    sums and 2n pairings; these are merged first over the blocks of B, then over those of A, so one pair of long songs
    spreads over its block pairs. ``top_*`` are arrays of (order, section_a, section_b, score), best first, equal
    scores by section_a and section_b. Pairs without sections on one side drop out.
    """
    row = F.struct(*[F.col(c).cast(k).alias(c) for c, k in zip(_SIDE, ("bigint", "double", "double", "boolean", "string"), strict=True)])
    blocks = sections.groupBy("song_id", F.floor(F.col("section_idx") / BLOCK).alias("_block")).agg(F.collect_list(row).alias("_rows"))
    side = lambda s: blocks.select(F.col("song_id").alias(f"song_{s}"), F.col("_block").alias(f"_block_{s}"), F.col("_rows").alias(f"_{s}"))
    d = pairs.select("pair_id", "song_a", "song_b").join(key_compat.select("pair_id", F.col("key_score").cast("double").alias("_key")), "pair_id").join(side("a"), "song_a").join(side("b"), "song_b")
    kept = ["pair_id", "song_a", "song_b", "_block_a"]
    top = "array<struct<`order`:double,section_a:bigint,section_b:bigint,score:double>>"

    def columns(rows: pa.Scalar) -> dict:
        flat = rows.values
        got = {c: flat.field(c) for c in _SIDE}
        return {"section_idx": got["section_idx"].to_numpy(), "has_vocals": got["has_vocals"].fill_null(False).to_numpy(zero_copy_only=False),
                "classification": got["classification"].to_numpy(zero_copy_only=False), **{c: got[c].to_numpy(zero_copy_only=False).astype(float) for c in ("energy", "spectral_centroid")}}

    def best(s: np.ndarray, a: dict, b: dict) -> list[dict]:
        r = np.round(s, 12)
        keep = min(n, r.size)
        edge = -np.partition(-r, keep - 1, axis=None)[keep - 1]
        i, j = np.nonzero(r >= edge)
        first = np.lexsort((b["section_idx"][j], a["section_idx"][i], -r[i, j]))[:keep]
        return [{"order": -r[x, y], "section_a": a["section_idx"][x], "section_b": b["section_idx"][y], "score": s[x, y]} for x, y in zip(i[first], j[first], strict=True)]

    def multiply(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            kind = batch.schema.field("_a").type
            for left, right, key in zip(batch.column("_a"), batch.column("_b"), batch.column("_key").to_pylist(), strict=True):
                a, b = columns(left), columns(right)
                key = np.nan if key is None else key
                sa, sb = _overall(a, b, True, key), _overall(b, a, False, key)
                for o, v in zip(out, (sa.sum(), sb.sum(), sa.size, best(sa, a, b), best(sb, a, b)), strict=True):
                    o.append(v)
            found = pa.list_(pa.struct([("order", pa.float64()), ("section_a", pa.int64()), ("section_b", pa.int64()), ("score", pa.float64())]))
            arrays = [batch.column(c) for c in kept] + [pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), pa.array(out[3], found), pa.array(out[4], found)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "_sum_a", "_sum_b", "_n", "top_a", "top_b"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    products = d.select(*kept, "_a", "_b", "_key").mapInArrow(multiply, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "_sum_a double, _sum_b double, _n bigint", f"top_a {top}", f"top_b {top}"]))

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        few = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, n).alias(c)
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_sum_a", "_sum_b", "_n")], few("top_a"), few("top_b"))

    whole = merged(merged(products, *kept), *kept[:3])
    return whole.select("pair_id", "song_a", "song_b", (F.col("_sum_a") / F.col("_n")).alias("direction_score_a"), (F.col("_sum_b") / F.col("_n")).alias("direction_score_b"), "top_a", "top_b")


def best_direction(summary: DataFrame) -> DataFrame:
    """Mean score by vocal role per pair; A is taken on a tie."""
    return summary.select("pair_id", "direction_score_a", "direction_score_b", _direction().alias("best_direction"))


def _direction() -> Column:
    return F.when(F.round("direction_score_a", 12) >= F.round("direction_score_b", 12), "a_vocals").otherwise("b_vocals")


def top_pairings(summary: DataFrame, direction: str | None = None) -> DataFrame:
    """Ranked pairings per pair in one direction (the pair's best one by default)."""
    d = summary.withColumn("direction", F.lit(direction) if direction else _direction())
    d = d.select("pair_id", "song_a", "song_b", "direction", F.posexplode(F.when(F.col("direction") == "a_vocals", F.col("top_a")).otherwise(F.col("top_b"))).alias("_i", "_p"))
    return d.select("pair_id", "song_a", "song_b", "_p.section_a", "_p.section_b", "direction", F.col("_p.score").alias("overall_score"), (F.col("_i") + 1).alias("rank"))


def match_songs(pairs: DataFrame, songs: DataFrame, sections: DataFrame, n: int = 10) -> DataFrame:
    """The match of two songs as one row: pair_id, song_a, song_b, tempo_strategy, stretch_ratio, key_score, direction_score_a,
    direction_score_b, best_direction and ``pairings``, the ``n`` best pairings of that direction.

    ``songs``: song_id, tempo, key_chroma; ``sections``: classified sections. The key score is that of the key profiles, .5
    where one has none; it enters every pairing.
    """
    d = attach_songs(pairs.select("pair_id", "song_a", "song_b"), songs, ["tempo", "key_chroma"])
    tempo = tempo_strategy(F.col("a_tempo"), F.col("b_tempo"))
    key = F.coalesce(chroma_compatibility(F.col("a_key_chroma"), F.col("b_key_chroma"), F.lit(0.5)), F.lit(0.5))
    d = materialize(d.select("pair_id", "song_a", "song_b", tempo["name"].alias("tempo_strategy"), tempo["ratio"].alias("stretch_ratio"), key.alias("key_score")), "song-matches")
    s = pairing_summary(d, sections, d, n)
    best = s.select("pair_id", "direction_score_a", "direction_score_b", _direction().alias("best_direction"), "top_a", "top_b")
    chosen = F.when(F.col("best_direction") == "a_vocals", F.col("top_a")).otherwise(F.col("top_b"))
    return d.join(best.withColumn("pairings", F.transform(chosen, lambda p: p.dropFields("order"))).drop("top_a", "top_b"), "pair_id")


# ---- alignment ----------------------------------------------------------------------------------

def best_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], frame: str, x: str, window: int) -> DataFrame:
    """Shift of b (-window .. window-1 frames) with the highest cross-correlation; first maximum wins.

    The lag list is short (a few frames), so each row of b meets its few partners by position.
    Series with fewer than twice ``window`` shared frames keep lag 0.
    """
    n = lambda d, c: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    size = n(a, "_na").join(n(b, "_nb"), list(keys)).select(*keys, F.least("_na", "_nb").alias("_n"))
    left = a.select(*keys, F.col(frame).alias("_f"), F.col(x).alias("_x")).join(size, list(keys)).where(F.col("_f") < F.col("_n"))
    right = b.select(*keys, F.col(frame).alias("_g"), F.col(x).alias("_y")).join(size, list(keys)).where(F.col("_g") < F.col("_n"))
    right = right.drop("_n").withColumn("lag", F.explode(F.sequence(F.lit(-window), F.lit(window - 1)))).withColumn("_f", F.col("_g") + F.col("lag"))
    sums = left.join(right, [*keys, "_f"]).groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s"), F.max("_n").alias("_n"))
    best = argmax_first(sums.where(F.col("_n") >= 2 * window), keys, F.round("_s", 9), F.col("lag"), {"lag": F.col("lag")})
    return size.select(*keys).join(best, list(keys), "left").na.fill(0, ["lag"])


def align_offset(pairs: DataFrame, first_a: str, first_b: str, tempo_b: str, sr: int = K.SAMPLE_RATE, max_bars: int = 4) -> DataFrame:
    """Adds offset: samples to move A so both first downbeats meet; 0 when it reaches ``max_bars`` bars."""
    off = F.col(first_b) - F.col(first_a)
    limit = (max_bars * (60.0 / F.greatest(F.col(tempo_b), F.lit(1.0))) * 4 * sr).cast("bigint")
    return pairs.withColumn("offset", F.when(F.abs(off) < limit, off).otherwise(0).cast("bigint"))


def shift_positions(samples: DataFrame, offsets: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Move every sample by its series' offset; what falls before zero is trimmed."""
    return samples.join(offsets.select(*keys, "offset"), list(keys)).withColumn(pos, F.col(pos) + F.col("offset")).where(
        F.col(pos) >= 0).drop("offset")


#: Beats of a stretch that travel as one row.
BEATS = 4096


def beat_f_measure(ref: DataFrame, est: DataFrame, keys: Sequence[str], t: str, tol: float = 0.07) -> DataFrame:
    """F-measure of estimated beats: the largest one-to-one matching within ``tol`` seconds.

    Beats of both kinds in order of time fall apart into stretches without a gap above ``tol``, a few beats each. Within
    one, a beat takes the earliest beat of the other kind that is still open and near enough, which no matching beats.
    A longer stretch is cut into chunks of ``BEATS``: a chunk turns the beats open before it into hits and the beats open
    behind it. Chunks are folded at once, and again where the chunk before turned out to leave other beats open, until
    none does; beats stay open for ``tol`` seconds only, so that is soon.
    """
    kind = lambda d, k: d.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(k).alias("_k"))
    beats = dense_index(kind(ref, 0).unionByName(kind(est, 1)), keys, ["_t", "_k"], F.floor(F.col("_t") / 64), "_i")
    near = halo_window(beats, keys, "_i", 1, 0, {"_gap": lambda w: F.col("_t") - F.lag("_t").over(w)})
    parts = carry(near, keys, "_i", F.when(F.col("_gap").isNull() | (F.col("_gap") > tol), F.col("_i")), "_part")
    part = [*keys, "_part"]
    chunks = parts.groupBy(*part, F.floor((F.col("_i") - F.col("_part")) / BEATS).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_t", "_k"))).alias("_b"))

    def step(state, beat):
        open_ = F.filter(state["open"], lambda o: beat["_t"] - o["_t"] <= tol)
        hit = F.coalesce(F.get(open_, F.lit(0))["_k"] != beat["_k"], F.lit(False))
        left = F.when(hit, F.slice(open_, 2, F.greatest(F.size(open_) - 1, F.lit(0)))).otherwise(F.concat(open_, F.array(beat)))
        return F.struct(left.alias("open"), (state["hits"] + hit.cast("bigint")).alias("hits"))

    def folded(d: DataFrame, before: Column) -> DataFrame:
        start = F.struct(before.alias("open"), F.lit(0).cast("bigint").alias("hits"))
        return d.withColumn("_in", before).withColumn("_s", F.aggregate("_b", start, step)).select(*part, "_chunk", "_b", "_in", F.col("_s.open").alias("_out"), F.col("_s.hits").alias("_h"))

    closed = F.array().cast("array<struct<_t:double,_k:int>>")
    chunks = materialize(folded(chunks, closed), "beat-chunks")
    behind = lambda d: d.select(*part, (F.col("_chunk") + 1).alias("_chunk"), F.col("_out").alias("_next"))
    settled, followers = chunks.select(*part, "_h", "_chunk"), chunks.where(F.col("_chunk") > 0)
    if followers.limit(1).count():  # only stretches of more than one chunk
        several = chunks.join(followers.select(*part).distinct(), part, "left_semi")
        while True:
            told = several.join(behind(several), [*part, "_chunk"], "left").withColumn("_next", F.coalesce("_next", closed))
            if not told.where(F.col("_next") != F.col("_in")).limit(1).count():
                break
            again = folded(told.where(F.col("_next") != F.col("_in")).drop("_in"), F.col("_next"))
            several = materialize(told.where(F.col("_next") == F.col("_in")).drop("_next").unionByName(again), "beat-chunks")
        settled = settled.join(several.select(*part).distinct(), part, "left_anti").unionByName(several.select(*part, "_h", "_chunk"))
    hits = settled.groupBy(*keys).agg(F.sum("_h").alias("_m"))
    count = lambda d, c: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    d = count(ref, "_nr").join(count(est, "_ne"), list(keys), "full_outer").join(hits, list(keys), "left").na.fill(0, ["_nr", "_ne", "_m"])
    p, q = F.col("_m") / F.when(F.col("_ne") > 0, F.col("_ne")), F.col("_m") / F.when(F.col("_nr") > 0, F.col("_nr"))
    return d.select(*keys, F.coalesce(F.when(p + q > 0, 2 * p * q / (p + q)), F.lit(0.0)).alias("f_measure"))
