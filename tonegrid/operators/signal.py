"""Framed-signal operators: levels, smoothing, novelty, activity, phrases, notes.

``keys`` name the series columns, ``order`` a dense integer position inside the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.constants import SAMPLE_RATE
from tonegrid.functions.scalars import clip, hz_to_midi, to_db
from tonegrid.operators.intervals import interval_join
from tonegrid.operators.ordered import (CHUNK, argmax_first, carry, dense_index, halo_window, quantiles,
                                        runs, with_group_stats, with_quantiles)
from tonegrid.session import materialize


# ---- levels -------------------------------------------------------------------------------------

def mono_mix(df: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Mean of all channels at each position."""
    return df.groupBy(*keys, pos).agg(F.avg(x).alias(x))


def mean_pitch(f0_frames: DataFrame, keys: Sequence[str], f0: str) -> DataFrame:
    """Mean of voiced (positive) pitch values per series; null when nothing is voiced."""
    return f0_frames.groupBy(*keys).agg(F.avg(F.when(F.col(f0) > 0, F.col(f0))).alias("mean_f0"))


def sum_stems(df: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Sum over stems at each position; a stem that ended counts as silence."""
    return df.groupBy(*keys, pos).agg(F.sum(x).alias(x))


def window_rms(df: DataFrame, keys: Sequence[str], pos: str, x: str, hop: int,
               drop_last: bool = False) -> DataFrame:
    """RMS per fixed window: keys, frame, rms.

    Only whole windows count, but a series shorter than one window gives one. ``drop_last`` also
    leaves out a window that ends exactly with the series.
    """
    b = (df.groupBy(*keys, F.floor(F.col(pos) / hop).cast("bigint").alias("frame"))
         .agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.max(pos).alias("_last")))
    b = with_group_stats(b, keys, (F.max("_last") + 1).alias("_len"))
    end = (F.col("frame") + 1) * hop
    keep = end < F.col("_len") if drop_last else (end <= F.col("_len")) | (F.col("frame") == 0)
    return b.where(keep).select(*keys, "frame", "rms")


def max_normalize(df: DataFrame, keys: Sequence[str], x: str, out: str) -> DataFrame:
    d = with_group_stats(df, keys, F.max(x).alias("_max"))
    return d.withColumn(out, F.when(F.col("_max") > 0, F.col(x) / F.col("_max")).otherwise(F.col(x))).drop("_max")


def minmax_normalize(df: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Scale each column to 0..1 in place; a range below 1e-10 gives 0."""
    d = with_group_stats(df, keys, *[a for x in xs for a in (F.min(x).alias(f"_mn_{x}"), F.max(x).alias(f"_mx_{x}"))])
    for x in xs:
        span = F.col(f"_mx_{x}") - F.col(f"_mn_{x}")
        d = d.withColumn(x, F.when(span < 1e-10, 0.0).otherwise((F.col(x) - F.col(f"_mn_{x}")) / span))
        d = d.drop(f"_mn_{x}", f"_mx_{x}")
    return d


def beat_energy(samples: DataFrame, beats: DataFrame, keys: Sequence[str], pos: str, x: str, t: str,
                beat_idx: str, sr: int = SAMPLE_RATE, chunk: int = CHUNK) -> DataFrame:
    """RMS between neighbouring beats, divided by the series maximum: keys, beat_idx, t, energy.

    A span covers at least one sample. Series with fewer than two beats use half-second windows.
    """
    n = with_group_stats(samples.select(*keys, pos), keys, (F.max(pos) + 1).alias("_len"))
    lengths = n.select(*keys, "_len").groupBy(*keys).agg(F.max("_len").alias("_len"))
    spans = halo_window(beats.select(*keys, F.col(beat_idx).alias("beat_idx"), F.col(t).alias("t")), keys,
                        "beat_idx", 0, 1, {"_next": lambda w: F.lead("t").over(w)}, chunk)
    spans = spans.where(F.col("_next").isNotNull()).join(lengths, list(keys))
    lo = F.greatest(F.lit(0), F.least((F.col("t") * sr).cast("bigint"), F.col("_len") - 1))
    hi = F.greatest(lo + 1, F.least((F.col("_next") * sr).cast("bigint"), F.col("_len")))
    spans = spans.select(*keys, "beat_idx", "t", lo.alias("_s"), hi.alias("_e"))
    on_beats = (interval_join(samples.select(*keys, pos, x), spans, keys, pos, "_s", "_e", float(sr))
                .groupBy(*keys, "beat_idx", "t").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("energy")))
    few = lengths.join(spans.select(*keys).distinct(), list(keys), "left_anti").select(*keys)
    windows = window_rms(samples.join(few, list(keys), "left_semi"), keys, pos, x, int(0.5 * sr))
    on_windows = windows.select(*keys, F.col("frame").alias("beat_idx"), (F.col("frame") * 0.5).alias("t"),
                                F.col("rms").alias("energy"))
    return max_normalize(on_beats.unionByName(on_windows), keys, "energy", "energy")


# ---- smoothing and novelty ----------------------------------------------------------------------

def _short(w, order: str, k: int, chunk: int) -> Column:
    """True in series of fewer than k rows, which lie wholly in the first chunk."""
    held = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (F.col(order) < chunk) & (held < k)


def moving_average(df: DataFrame, keys: Sequence[str], order: str, xs: Sequence[str], k: int,
                   chunk: int = CHUNK) -> DataFrame:
    """Centred k-tap mean with zero edges, in place; series shorter than k stay unchanged."""
    if k <= 1:
        return df
    left, right = k // 2, (k // 2 - 1 if k % 2 == 0 else k // 2)

    def mean(x):
        return lambda w: F.when(_short(w, order, k, chunk), F.col(x)).otherwise(
            F.sum(x).over(w.rowsBetween(-left, right)) / k)

    d = halo_window(df, keys, order, left, right, {f"_ma_{x}": mean(x) for x in xs}, chunk)
    return d.drop(*xs).withColumnsRenamed({f"_ma_{x}": x for x in xs})


def smooth3(df: DataFrame, keys: Sequence[str], order: str, x: str, chunk: int = CHUNK) -> DataFrame:
    """.25/.5/.25 smoothing with zero edges, in place; series of fewer than three stay unchanged."""
    d = halo_window(df, keys, order, 1, 1, {"_s3": lambda w: F.when(_short(w, order, 3, chunk), F.col(x)).otherwise(
        0.25 * F.coalesce(F.lag(x).over(w), F.lit(0.0)) + 0.5 * F.col(x)
        + 0.25 * F.coalesce(F.lead(x).over(w), F.lit(0.0)))}, chunk)
    return d.drop(x).withColumnRenamed("_s3", x)


def vector_novelty(df: DataFrame, keys: Sequence[str], order: str, vectors: Sequence[str],
                   scalars: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Change to the next frame: L2 distance of arrays, absolute difference of scalars.

    Adds ``<column>_novelty``; the last frame of a series has no successor and is left out.
    """
    def dist(v):
        return lambda w: F.sqrt(F.aggregate(
            F.zip_with(F.lead(v).over(w), F.col(v), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))

    cols = {f"{v}_novelty": dist(v) for v in vectors}
    cols |= {f"{s}_novelty": (lambda w, s=s: F.abs(F.lead(s).over(w) - F.col(s))) for s in scalars}
    first = next(iter(cols))
    return halo_window(df, keys, order, 0, 1, cols, chunk).where(F.col(first).isNotNull())


def combined_novelty(df: DataFrame, keys: Sequence[str], order: str, mfcc: str, chroma: str, rms: str,
                     k: int = 16, chunk: int = CHUNK) -> DataFrame:
    """Weighted boundary strength from three smoothed, scaled novelties, with its adaptive threshold.

    Gives keys, order, novelty, threshold (median plus half a standard deviation).
    """
    parts = [f"{c}_novelty" for c in (mfcc, chroma, rms)]
    n = vector_novelty(df, keys, order, [mfcc, chroma], [rms], chunk).select(*keys, order, *parts)
    n = materialize(moving_average(n, keys, order, parts, k, chunk), "novelty")
    n = minmax_normalize(n, keys, parts)
    n = n.select(*keys, order, (F.col(parts[0]) * 0.40 + F.col(parts[1]) * 0.35 + F.col(parts[2]) * 0.25).alias("novelty"))
    n = n.join(quantiles(n, keys, F.col("novelty"), {"_med": 0.5}, F.stddev_pop("_v").alias("_sd")), list(keys))
    return n.select(*keys, order, "novelty", (F.col("_med") + 0.5 * F.col("_sd")).alias("threshold"))


def local_maxima(df: DataFrame, keys: Sequence[str], order: str, x: str, threshold: Column | None = None,
                 chunk: int = CHUNK) -> DataFrame:
    """Rows strictly above both neighbours and above ``threshold``; the ends never qualify."""
    d = halo_window(df, keys, order, 1, 1, {
        "_p": lambda w: F.lag(x).over(w), "_n": lambda w: F.lead(x).over(w)}, chunk)
    keep = (F.col(x) > F.col("_p")) & (F.col(x) > F.col("_n"))
    if threshold is not None:
        keep = keep & (F.col(x) > threshold)
    return d.where(keep).drop("_p", "_n")


def onset_strength(df: DataFrame, keys: Sequence[str], order: str, logmel: str, out: str = "onset",
                   chunk: int = CHUNK) -> DataFrame:
    """Mean positive rise over the mel bands against the previous frame; 0 at the first frame."""
    def build(w):
        rise = F.zip_with(F.col(logmel), F.lag(logmel).over(w), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.coalesce(F.aggregate(rise, F.lit(0.0), lambda s, v: s + v) / F.size(logmel), F.lit(0.0))
    return halo_window(df, keys, order, 1, 0, {out: build}, chunk)


def change_points(df: DataFrame, keys: Sequence[str], order: str, label: str, chunk: int = CHUNK) -> DataFrame:
    """Rows whose label differs from the row before; the first row never qualifies."""
    d = halo_window(df, keys, order, 1, 0, {"_p": lambda w: F.lag(label).over(w)}, chunk)
    return d.where(F.col("_p") != F.col(label)).drop("_p")


# ---- activity and phrases -----------------------------------------------------------------------

def activity_rms(df: DataFrame, keys: Sequence[str], order: str, x: str) -> DataFrame:
    """Adds level (x over series maximum), threshold and active."""
    peak = df.groupBy(*keys).agg(F.max(x).alias("_max"))
    level = F.when(F.col("_max") >= 1e-6, F.col(x) / F.col("_max")).otherwise(0.0)
    audible = df.select(*keys, x).join(peak, list(keys)).select(*keys, level.alias("_l")).where(F.col("_l") > 0.01)
    limits = materialize(peak.join(quantiles(audible, keys, F.col("_l"), {"_med": 0.5}), list(keys), "left"), "limits")
    d = df.join(limits, list(keys)).withColumn("level", level)
    d = d.withColumn("threshold", F.greatest(F.lit(0.10), F.coalesce("_med", F.lit(0.1)) * 0.5))
    return d.withColumn("active", (F.col("_max") >= 1e-6) & (F.col("level") > F.col("threshold"))).drop("_max", "_med")


def bridge_gaps(df: DataFrame, keys: Sequence[str], order: str, active: str, out: str = "activity",
                reach: int = 4, chunk: int = CHUNK) -> DataFrame:
    """1 for active frames, 0.5 for bridged ones, else 0.

    Filling runs left to right and sees its own fills. For a gap of L frames between two active
    frames that means: nothing is filled above 2*reach-2, else its last min(L, reach-1) frames are.
    """
    far = 2 * reach - 2
    return halo_window(df, keys, order, far, far, {out: _bridged(order, active, reach)}, chunk)


def _bridged(order: str, active: str, reach: int):
    far = 2 * reach - 2
    on = F.when(F.col(active), F.col(order))

    def value(w):
        before, after = F.max(on).over(w.rowsBetween(-far, -1)), F.min(on).over(w.rowsBetween(1, far))
        filled = (after - before - 1 <= far) & (after - F.col(order) <= reach - 1)
        return F.when(F.col(active), 1.0).when(filled, 0.5).otherwise(0.0)

    return value


def drop_short_runs(df: DataFrame, keys: Sequence[str], order: str, activity: str, n: int = 2,
                    chunk: int = CHUNK) -> DataFrame:
    """Zero ``activity`` in positive runs shorter than n frames, in place."""
    return halo_window(df, keys, order, n, n, {activity: _long_runs(order, activity, n)}, chunk)


def _long_runs(order: str, activity: str, n: int):
    off = F.when(F.col(activity) <= 0, F.col(order))

    def before(w):
        seen = w.rowsBetween(-n, -1)
        return F.coalesce(F.max(off).over(seen), F.when(F.count(F.lit(1)).over(seen) < n, F.lit(-1)))

    def after(w):
        seen = w.rowsBetween(1, n)
        held = F.count(F.lit(1)).over(seen)
        return F.coalesce(F.min(off).over(seen), F.when(held < n, F.col(order) + held + 1))

    def value(w):
        return F.when(F.coalesce(after(w) - before(w) - 1 < n, F.lit(False)), 0.0).otherwise(F.col(activity))

    return value


def islands(df: DataFrame, keys: Sequence[str], order: str, activity: str, x: str, hop_s: float = 0.25,
            strong: float = 0.03, chunk: int = CHUNK) -> DataFrame:
    """Phrases from positive activity: keys, start_time, end_time, energy, is_strong."""
    r = runs(df.where(F.col(activity) > 0), keys, order,
             {"_sq": ("sum", F.col(x) * F.col(x))}, chunk=chunk)
    energy = F.sqrt(F.col("_sq") / F.col("run_length"))
    return r.select(*keys, (F.col("run_start") * hop_s).alias("start_time"),
                    ((F.col("run_end") + 1) * hop_s).alias("end_time"),
                    energy.alias("energy"), (energy > strong).alias("is_strong"))


def active_phrases(frames: DataFrame, keys: Sequence[str], order: str, x: str, hop_s: float = 0.25,
                   chunk: int = CHUNK) -> DataFrame:
    """Threshold, bridge, drop short bursts, cut into phrases.

    Bridging and dropping share one pass whose copied rows reach as far as both together.
    """
    reach, n = 4, 2
    a = activity_rms(frames, keys, order, x).select(*keys, order, x, "active")
    halo = 2 * reach - 2 + n
    a = halo_window(a, keys, order, halo, halo, {"_bridged": _bridged(order, "active", reach), "activity": _long_runs(order, "_bridged", n)}, chunk)
    return materialize(islands(a, keys, order, "activity", x, hop_s, chunk=chunk), "phrases")


def db_gate_phrases(frames: DataFrame, keys: Sequence[str], order: str, x: str, sr: int = SAMPLE_RATE,
                    hop: int = 256, bridge_s: float = 0.4, min_s: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """Phrases above an adaptive dB gate: keys, start, end (samples), duration (s), energy.

    Gaps up to ``bridge_s`` are closed and count into the energy; shorter phrases than ``min_s`` go.
    """
    d = frames.select(*keys, order, x).withColumn("_db", to_db(F.col(x), 1e-8))
    gate = quantiles(d, keys, F.col("_db"), {"_p": 0.15}).withColumn("_thr", clip(F.col("_p"), -55, -25)).drop("_p")
    on = d.join(gate, list(keys)).where(F.col("_db") > F.col("_thr"))
    r = runs(on, keys, order, gap=int(bridge_s * sr / hop), chunk=chunk)
    r = r.where(F.col("run_length") >= int(min_s * sr / hop))
    r = r.select(*keys, "run_start", (F.col("run_end") + 1).alias("_stop"))
    e = (interval_join(d, r, keys, order, "run_start", "_stop", 4096.0)
         .groupBy(*keys, "run_start", "_stop").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("energy")))
    return e.select(*keys, (F.col("run_start") * hop).alias("start"), (F.col("_stop") * hop).alias("end"),
                    ((F.col("_stop") - F.col("run_start")) * hop / F.lit(float(sr))).alias("duration"), "energy")


def hysteresis(df: DataFrame, keys: Sequence[str], order: str, x: str, on: float = 1.2, off: float = 0.6,
               chunk: int = CHUNK) -> DataFrame:
    """Adds active: switches on above on*threshold, off below off*threshold.

    The threshold is the 20th percentile of values above 0.001, or 0.001.
    """
    d = with_quantiles(df, keys, F.when(F.col(x) > 0.001, F.col(x)), {"_p": 0.2})
    thr = F.coalesce("_p", F.lit(0.001))
    switch = F.when(F.col(x) > thr * on, 1).when(F.col(x) < thr * off, 0)
    d = carry(d, keys, order, switch, "_on", chunk=chunk)
    return d.withColumn("active", F.coalesce("_on", F.lit(0)) == 1).drop("_p", "_on")


def ramp_mask(df: DataFrame, keys: Sequence[str], order: str, mask: str, ramp: int,
              chunk: int = CHUNK) -> DataFrame:
    """Linear ramps of ``ramp`` positions around each switch of a 0/1 mask, in place.

    Where ramps overlap a falling one beats a rising one and a later one beats an earlier one.
    """
    h = ramp // 2
    if h == 0:
        return df
    d = with_group_stats(df, keys, (F.max(order) + 1).alias("_len"))
    step = lambda w: F.lead(mask).over(w) - F.col(mask)
    d = halo_window(d, keys, order, 0, 1, {"_step": step}, chunk)
    reach = lambda cond: (lambda w: F.max(F.when(cond, F.col(order))).over(w.rowsBetween(-(h - 1), h)))
    d = halo_window(d, keys, order, h, h, {"_fall": reach(F.col("_step") < -0.5),
                                           "_rise": reach(F.col("_step") > 0.5)}, chunk)
    pt = F.coalesce("_fall", "_rise")
    lo, hi = F.greatest(pt - h, F.lit(0)), F.least(pt + h, F.col("_len"))
    up = F.when(hi - lo > 1, (F.col(order) - lo) / (hi - lo - 1)).otherwise(0.0)
    value = F.when(F.col("_fall").isNotNull(), 1.0 - up).when(F.col("_rise").isNotNull(), up).otherwise(F.col(mask))
    return d.withColumn(mask, clip(value, 0, 1)).drop("_len", "_step", "_fall", "_rise")


def keep_top_ratio(phrases: DataFrame, keys: Sequence[str], quality: str, energy: str, tie: str,
                   scoreable: Column, ratio: float = 0.7) -> DataFrame:
    """Best ``ratio`` of the scoreable phrases per series (at least one); a series with none stays whole.

    Equal quality keeps the louder, then lower ``tie``. Ranking is split by quality band.
    """
    p = materialize(phrases.withColumn("_q", F.when(scoreable, F.col(quality))), "scored-phrases")
    p = with_group_stats(p, keys, F.count("_q").alias("_n"))
    d = p.where(F.col("_q").isNotNull()).withColumn("_nq", -F.col("_q")).withColumn("_ne", -F.col(energy))
    ranked = dense_index(d, keys, ["_nq", "_ne", tie], F.floor(F.col("_nq") * 4096), "_rank")
    kept = ranked.where(F.col("_rank") < F.greatest(F.lit(1), (F.col("_n") * F.lit(ratio)).cast("int")))
    return kept.drop("_nq", "_ne", "_rank", "_q", "_n").unionByName(p.where(F.col("_n") == 0).drop("_q", "_n"))


def notes(f0_frames: DataFrame, keys: Sequence[str], order: str, t: str, f0: str, chunk: int = CHUNK) -> DataFrame:
    """Voiced runs of a pitch contour as notes, numbered per series."""
    voiced = f0_frames.where(F.col(f0) > 0)
    r = runs(voiced, keys, order, {"start_time": ("min", F.col(t)), "end_time": ("max", F.col(t))}, chunk=chunk)
    r = dense_index(r, keys, ["run_start"], F.floor(F.col("run_start") / chunk), "_i")
    r = r.withColumn("_stop", F.col("run_end") + 1)
    n = (interval_join(voiced.select(*keys, order, f0), r, keys, order, "run_start", "_stop", 4096.0)
         .groupBy(*keys, "_i", "start_time", "end_time")
         .agg(F.avg(f0).alias("frequency"), F.stddev_pop(f0).alias("frequency_std")))
    return n.select(*keys, F.format_string("note_%03d", F.col("_i") + 1).alias("note_id"),
                    hz_to_midi(F.col("frequency")).alias("midi_number"), "frequency", "frequency_std",
                    "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"),
                    (1.0 - F.col("frequency_std") / F.col("frequency")).alias("confidence"))


def energy_phrases(frames: DataFrame, keys: Sequence[str], order: str, t: str, x: str,
                   min_frames: int = 3, min_s: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """Runs above the series' 40th percentile, at least three frames and longer than half a second."""
    d = with_quantiles(frames.select(*keys, order, t, x), keys, F.col(x), {"_p": 0.4}).where(F.col(x) > F.col("_p"))
    r = runs(d, keys, order, {"start_time": ("min", F.col(t)), "end_time": ("max", F.col(t))}, chunk=chunk)
    r = r.where((F.col("run_length") >= min_frames) & (F.col("end_time") - F.col("start_time") > min_s))
    r = dense_index(r, keys, ["run_start"], F.floor(F.col("run_start") / chunk), "_i").withColumn("_stop", F.col("run_end") + 1)
    e = (interval_join(d.select(*keys, order, x), r, keys, order, "run_start", "_stop", 4096.0)
         .groupBy(*keys, "_i", "start_time", "end_time")
         .agg(F.avg(x).alias("energy_mean"), F.stddev_pop(x).alias("energy_std")))
    return e.select(*keys, F.format_string("phrase_%03d", F.col("_i") + 1).alias("phrase_id"), "start_time", "end_time",
                    (F.col("end_time") - F.col("start_time")).alias("duration"), "energy_mean", "energy_std")


def loudest_window(samples: DataFrame, keys: Sequence[str], pos: str, x: str, seconds: int,
                   sr: int = SAMPLE_RATE, chunk: int = CHUNK) -> DataFrame:
    """Loudest ``seconds`` stretch per series in one-second steps: keys, start_pos, end_pos.

    The first maximum wins; a series no longer than the window is returned whole.
    """
    sec = (samples.groupBy(*keys, F.floor(F.col(pos) / sr).cast("bigint").alias("_s"))
           .agg(F.sum(F.col(x) * F.col(x)).alias("_e"), F.max(pos).alias("_last")))
    sec = with_group_stats(sec, keys, (F.max("_last") + 1).alias("_len"))
    roll = halo_window(sec, keys, "_s", 0, seconds - 1, {
        "_sum": lambda w: F.sum("_e").over(w.rowsBetween(0, seconds - 1))}, chunk)
    size = seconds * sr
    whole = roll.where(F.col("_len") <= size).groupBy(*keys).agg(
        F.lit(0).cast("bigint").alias("start_pos"), F.max("_len").alias("end_pos"))
    best = argmax_first(roll.where(F.col("_s") * sr < F.col("_len") - size), keys, F.round("_sum", 9), F.col("_s"),
                        {"_s": F.col("_s")})
    return best.select(*keys, (F.col("_s") * sr).alias("start_pos"),
                       (F.col("_s") * sr + size).alias("end_pos")).unionByName(whole)
