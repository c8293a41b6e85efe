"""Beats, boundaries, sections and bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.constants import BEATS_PER_BAR, SAMPLE_RATE
from tonegrid.functions.scalars import fold_tempo
from tonegrid.operators.folds import spaced_points
from tonegrid.operators.intervals import interval_join, nearest
from tonegrid.operators.ordered import (CHUNK, argmax_first, dense_index, halo_window, quantiles,
                                        with_group_stats, with_quantiles)
from tonegrid.session import materialize
from tonegrid.operators.signal import combined_novelty, local_maxima, max_normalize, smooth3


# ---- beats --------------------------------------------------------------------------------------

def beat_intervals(beats: DataFrame, keys: Sequence[str], beat_idx: str, t: str, chunk: int = CHUNK) -> DataFrame:
    return halo_window(beats.select(*keys, beat_idx, t), keys, beat_idx, 1, 0,
                       {"interval": lambda w: F.col(t) - F.lag(t).over(w)}, chunk)


def tempo_from_beats(beats: DataFrame, keys: Sequence[str], beat_idx: str, t: str) -> DataFrame:
    """Tempo from the median beat interval, folded once into range; 120 when there is no interval."""
    d = beat_intervals(beats, keys, beat_idx, t)
    med = quantiles(d, keys, F.col("interval"), {"_m": 0.5})
    every = beats.select(*keys).distinct().join(med, list(keys), "left")
    return every.select(*keys, F.coalesce(fold_tempo(60.0 / F.when(F.col("_m") > 0, F.col("_m"))), F.lit(120.0)).alias("tempo"))


def tempo_stable(beats: DataFrame, keys: Sequence[str], beat_idx: str, t: str, cv: float = 0.15) -> DataFrame:
    """Interval spread below ``cv`` of the mean; up to four beats count as stable."""
    s = beat_intervals(beats, keys, beat_idx, t).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("interval").alias("_m"), F.stddev_pop("interval").alias("_s"))
    ratio = F.when(F.col("_m") > 0, F.round(F.col("_s") / F.col("_m"), 12)).otherwise(1.0)
    return s.select(*keys, F.when(F.col("_n") > 4, ratio < cv).otherwise(True).alias("stable"))


def downbeat_phase(beats: DataFrame, keys: Sequence[str], beat_idx: str, strength: str,
                   limit: int | None = None) -> DataFrame:
    """Phase 0..3 with the strongest mean; first wins; fewer than four beats give 0."""
    b = beats if limit is None else beats.where(F.col(beat_idx) < limit)
    by = b.groupBy(*keys, F.pmod(F.col(beat_idx), F.lit(BEATS_PER_BAR)).cast("int").alias("phase")).agg(
        F.avg(strength).alias("_s"), F.count(F.lit(1)).alias("_c"))
    by = by.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))  # at most four rows each
    score = F.when(F.col("_n") >= BEATS_PER_BAR, F.round("_s", 12)).otherwise(-F.col("phase"))
    return argmax_first(by, keys, score, F.col("phase"), {"phase": F.col("phase")})


def downbeats(beats: DataFrame, keys: Sequence[str], beat_idx: str, strength: str,
              limit: int | None = None) -> DataFrame:
    """Every fourth beat from the phase; all beats where a series has fewer than four."""
    ph = downbeat_phase(beats, keys, beat_idx, strength, limit)
    n = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = beats.join(ph.join(n, list(keys)), list(keys))
    on = F.pmod(F.col(beat_idx), F.lit(BEATS_PER_BAR)) == F.col("phase")
    return d.where((F.col("_n") < BEATS_PER_BAR) | on).drop("phase", "_n")


def first_strong_beat(beats: DataFrame, keys: Sequence[str], beat_idx: str, strength: str, n: int = 8) -> DataFrame:
    """Strongest of the first n beats; the first one on ties."""
    return argmax_first(beats.where(F.col(beat_idx) < n), keys, F.col(strength), F.col(beat_idx),
                        {beat_idx: F.col(beat_idx)})


def snap_nearest(points: DataFrame, grid: DataFrame, beats: DataFrame, keys: Sequence[str], t: str,
                 grid_t: str, beat_t: str, out: str) -> DataFrame:
    """Nearest downbeat, else nearest beat, else unchanged."""
    marks = grid.select(*keys, F.col(grid_t).alias("_mark"))
    bare = beats.join(marks.select(*keys).distinct(), list(keys), "left_anti")
    marks = materialize(marks.unionByName(bare.select(*keys, F.col(beat_t).alias("_mark"))), "snap-grid")
    d = nearest(points, marks, keys, t, "_mark", "_near")
    return d.withColumn(out, F.coalesce("_near", F.col(t).cast("double"))).drop("_near")


def beats_in_range(sections: DataFrame, beats: DataFrame, keys: Sequence[str], section_idx: str, start: str,
                   end: str, t: str) -> DataFrame:
    """Adds n_beats (both ends closed) and n_bars."""
    hit = (interval_join(beats.select(*keys, t), sections.select(*keys, section_idx, start, end), keys, t, start, end,
                         16.0, closed_end=True)
           .groupBy(*keys, section_idx).agg(F.count(F.lit(1)).alias("n_beats")))
    d = sections.join(hit, [*keys, section_idx], "left")
    n = F.coalesce("n_beats", F.lit(0)).cast("bigint")
    return d.withColumn("n_beats", n).withColumn("n_bars", F.floor(F.col("n_beats") / BEATS_PER_BAR).cast("bigint"))


# ---- boundaries and sections --------------------------------------------------------------------

def boundary_peaks(df: DataFrame, keys: Sequence[str], order: str, mfcc: str, chroma: str, rms: str,
                   min_frames: int, k: int = 16) -> DataFrame:
    """Boundary frames: novelty peaks above the threshold, at least ``min_frames`` apart."""
    n = combined_novelty(df, keys, order, mfcc, chroma, rms, k)
    peaks = local_maxima(n, keys, order, "novelty", F.col("threshold"))
    return spaced_points(peaks, keys, order, float(min_frames))


def clean_boundaries(points: DataFrame, lengths: DataFrame, keys: Sequence[str], t: str, duration: str,
                     min_gap: float = 12.0) -> DataFrame:
    """Section edges from (snapped) inner points: keys, edge_idx, ``t``.

    Zero and the end are added. Points closer than ``min_gap`` to the last kept one go; an end that
    is too close takes the place of the last kept point.
    """
    inner = materialize(points.select(*keys, F.col(t).cast("double").alias(t)), "inner-edges")
    ends = lengths.select(*keys, F.col(duration).cast("double").alias(t))
    starts = lengths.select(*keys, F.lit(0.0).alias(t))
    edge = inner.unionByName(ends).groupBy(*keys).agg(F.max(t).alias("_end"))
    body = inner.unionByName(starts).join(edge, list(keys)).where(F.col(t) < F.col("_end"))
    kept = with_group_stats(spaced_points(body, keys, t, min_gap), keys, F.max(t).alias("_last")).join(edge, list(keys))
    kept = kept.where((F.col(t) < F.col("_last")) | (F.col("_end") - F.col("_last") >= min_gap))
    out = kept.select(*keys, t).unionByName(edge.select(*keys, F.col("_end").alias(t)))
    return dense_index(out, keys, [t], F.floor(F.col(t) / 4096.0), "edge_idx")


def sections_from_edges(edges: DataFrame, keys: Sequence[str], t: str, edge_idx: str = "edge_idx",
                        min_s: float = 2.0) -> DataFrame:
    """Spans between neighbouring edges lasting at least ``min_s``, renumbered."""
    d = halo_window(edges, keys, edge_idx, 0, 1, {"end_time": lambda w: F.lead(t).over(w)})
    d = d.where(F.col("end_time") - F.col(t) >= min_s).withColumn("start_time", F.col(t))
    d = dense_index(d, keys, [edge_idx], F.floor(F.col(edge_idx) / CHUNK), "section_idx")
    return d.select(*keys, "section_idx", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"))


def section_energy(sections: DataFrame, frames: DataFrame, keys: Sequence[str], t: str, rms: str, centroid: str,
                   min_s: float = 2.0) -> DataFrame:
    """Adds energy (RMS over the section's frames, divided by the song maximum) and spectral_centroid."""
    s = sections.where(F.col("end_time") - F.col("start_time") >= min_s)
    a = (interval_join(frames.select(*keys, t, rms, centroid), s.select(*keys, "section_idx", "start_time", "end_time"),
                       keys, t, "start_time", "end_time", 16.0)
         .groupBy(*keys, "section_idx").agg(F.sqrt(F.avg(F.col(rms) * F.col(rms))).alias("energy"),
                                            F.avg(centroid).alias("spectral_centroid")))
    d = s.join(a, [*keys, "section_idx"], "left").na.fill(0.0, ["energy", "spectral_centroid"])
    return max_normalize(d, keys, "energy", "energy")


def vocal_density(sections: DataFrame, activity: DataFrame, keys: Sequence[str], frame: str, active: str,
                  hop_s: float = 0.25) -> DataFrame:
    """Adds vocal_density (share of active frames in [int(s/hop), int(e/hop))) and has_vocals."""
    s = sections.select(*keys, "section_idx", (F.col("start_time") / hop_s).cast("bigint").alias("_s"),
                        (F.col("end_time") / hop_s).cast("bigint").alias("_e"))
    hit = (interval_join(activity.select(*keys, frame, active), s, keys, frame, "_s", "_e", 64.0)
           .groupBy(*keys, "section_idx").agg(F.avg((F.col(active) > 0).cast("double")).alias("vocal_density")))
    d = sections.drop("vocal_density", "has_vocals").join(hit, [*keys, "section_idx"], "left")
    return d.na.fill(0.0, ["vocal_density"]).withColumn("has_vocals", F.col("vocal_density") > 0.25)


def drum_dominance(sections: DataFrame, curve: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """Adds drum_dominant: the section's mean drum level is over 1.1 times the song's."""
    dur = sections.groupBy(*keys).agg(F.greatest(F.max("end_time"), F.lit(1.0)).alias("_dur"))
    whole = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"))
    s = sections.join(dur, list(keys)).join(whole, list(keys), "left")
    at = lambda c: (F.col(c) / F.col("_dur") * F.col("_n")).cast("bigint")
    s = s.withColumn("_s", F.greatest(F.lit(0), at("start_time"))).withColumn("_e", F.least(at("end_time"), F.col("_n")))
    spans = s.where(F.col("_e") > F.col("_s")).select(*keys, "section_idx", "_s", "_e")
    hit = (interval_join(curve.select(*keys, idx, value), spans, keys, idx, "_s", "_e", 64.0)
           .groupBy(*keys, "section_idx").agg(F.avg(value).alias("_dm")))
    d = s.drop("_s", "_e", "_dur", "_n").join(hit, [*keys, "section_idx"], "left")
    return d.withColumn("drum_dominant", F.coalesce(F.col("_dm") > F.col("_mean") * 1.1, F.lit(False))).drop("_mean", "_dm")


def classify_sections(sections: DataFrame, keys: Sequence[str], section_idx: str = "section_idx") -> DataFrame:
    """Adds classification from position, energy percentiles, rise into the next section and vocals."""
    d = with_group_stats(sections, keys, F.count(F.lit(1)).alias("_n"))
    d = with_quantiles(d, keys, F.col("energy"), {"_p75": 0.75, "_p40": 0.40, "_p20": 0.20})
    d = halo_window(d, keys, section_idx, 0, 1, {"_next": lambda w: F.lead("energy").over(w)})
    e, vox = F.col("energy"), F.col("has_vocals")
    position = F.col(section_idx) / F.greatest(F.col("_n") - 1, F.lit(1))
    building = F.coalesce((e > 0) & (F.col("_next") > e * 1.2), F.lit(False))
    label = (F.when((position < 0.08) & (e < F.col("_p40")), "intro")
             .when((position > 0.90) & (e < F.col("_p40")), "outro")
             .when(e <= F.col("_p20"), "breakdown")
             .when(building & ~vox, "buildup")
             .when((e >= F.col("_p75")) & ~vox, "drop")
             .when((e >= F.col("_p75")) & vox, "chorus")
             .when(vox, "verse")
             .when(e >= F.col("_p40"), "instrumental")
             .otherwise("verse"))
    return d.withColumn("classification", label).drop("_n", "_p75", "_p40", "_p20", "_next")


def label_sections_median(sections: DataFrame, keys: Sequence[str], section_idx: str = "section_idx") -> DataFrame:
    """Adds label relative to the median energy of the song."""
    d = with_group_stats(sections, keys, F.max(section_idx).alias("_top"))
    d = with_quantiles(d, keys, F.col("energy"), {"_m": 0.5})
    e, m, i = F.col("energy"), F.col("_m"), F.col(section_idx)
    label = (F.when((i == 0) & (e < m * 0.75), "intro")
             .when((i == F.col("_top")) & (e < m * 0.75), "outro")
             .when(e > m * 1.3, "chorus").when(e < m * 0.65, "breakdown").otherwise("verse"))
    return d.withColumn("label", label).drop("_top", "_m")


# ---- bars ---------------------------------------------------------------------------------------

def bar_rms(samples: DataFrame, keys: Sequence[str], pos: str, stem: str, x: str, bar_samples: int,
            stems: Sequence[str] = ("drums", "bass", "other")) -> DataFrame:
    """RMS per bar with one column per stem, 0 where a stem is missing; at least one bar per series."""
    per = (samples.groupBy(*keys, F.floor(F.col(pos) / bar_samples).cast("bigint").alias("bar"))
           .agg(F.max(pos).alias("_last"),
                *[F.sqrt(F.avg(F.when(F.col(stem) == s, F.col(x) * F.col(x)))).alias(s) for s in stems]))
    bars = per.groupBy(*keys).agg((F.max("_last") + 1).alias("_len"))
    n = F.greatest(F.lit(1), F.floor(F.col("_len") / bar_samples)).cast("bigint")
    grid = bars.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("bar"))
    return grid.join(per.drop("_last"), [*keys, "bar"], "left").na.fill(0.0, list(stems))


def adaptive_bar_energy(bars: DataFrame, keys: Sequence[str],
                        stems: Sequence[str] = ("drums", "bass", "other")) -> DataFrame:
    """Adds energy: stems weighted by their relative spread over the song."""
    d = with_group_stats(bars, keys, *[a for s in stems for a in (
        F.stddev_pop(s).alias(f"_sd_{s}"), F.avg(s).alias(f"_m_{s}"))])
    dyn = {s: F.col(f"_sd_{s}") / (F.col(f"_m_{s}") + 1e-8) for s in stems}
    total = sum(dyn.values(), F.lit(0.0)) + 1e-8
    energy = sum((F.col(s) * (dyn[s] / total) for s in stems), F.lit(0.0))
    return d.withColumn("energy", energy).drop(*[f"_{p}_{s}" for s in stems for p in ("sd", "m")])


def label_bars(bars: DataFrame, keys: Sequence[str], energy: str = "energy") -> DataFrame:
    """Adds label drop/groove/build/breakdown by the song's 75th, 40th and 20th percentile."""
    d = with_quantiles(bars, keys, F.col(energy), {"_p75": 0.75, "_p40": 0.40, "_p20": 0.20})
    e = F.col(energy)
    label = (F.when(e >= F.col("_p75"), "drop").when(e >= F.col("_p40"), "groove")
             .when(e >= F.col("_p20"), "build").otherwise("breakdown"))
    return d.withColumn("label", label).drop("_p75", "_p40", "_p20")


def analyze_bars(samples: DataFrame, keys: Sequence[str], pos: str, stem: str, x: str, bar_samples: int) -> DataFrame:
    """Bar energies (weighted, smoothed, scaled to 1) and labels: keys, bar, energy, label."""
    b = materialize(bar_rms(samples, keys, pos, stem, x, bar_samples), "bar-levels")
    b = smooth3(adaptive_bar_energy(b, keys).select(*keys, "bar", "energy"), keys, "bar", "energy")
    b = materialize(max_normalize(b, keys, "energy", "energy"), "bar-energy")
    return label_bars(b, keys)


def label_phrases(phrases: DataFrame, keys: Sequence[str], energy: str = "energy") -> DataFrame:
    """Adds type hook/groove/atmosphere by the song's 75th and 50th percentile."""
    d = with_quantiles(phrases, keys, F.col(energy), {"_p75": 0.75, "_p50": 0.50})
    e = F.col(energy)
    kind = F.when(e >= F.col("_p75"), "hook").when(e >= F.col("_p50"), "groove").otherwise("atmosphere")
    return d.withColumn("type", kind).drop("_p75", "_p50")


def label_counts(bars: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return bars.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def drop_starts(bars: DataFrame, keys: Sequence[str], bar: str = "bar", label: str = "label",
                chunk: int = CHUNK) -> DataFrame:
    """Bars labelled drop whose predecessor is not."""
    d = halo_window(bars, keys, bar, 1, 0, {"_p": lambda w: F.lag(label).over(w)}, chunk)
    return d.where((F.col(label) == "drop") & (F.col("_p") != "drop")).drop("_p")


def sweep_schedule(bars: DataFrame, keys: Sequence[str], bar_samples: int, sr: int = SAMPLE_RATE,
                   sweep_bars: int = 2, segments: int = 16) -> DataFrame:
    """Cutoff steps over the two bars before each drop: keys, drop_bar, segment, start, end, cutoff."""
    nyq = sr / 2.0
    starts = drop_starts(bars, keys).select(*keys, F.col("bar").alias("drop_bar"))
    s = F.greatest(F.lit(0), F.col("drop_bar") - sweep_bars) * bar_samples
    e = F.col("drop_bar") * bar_samples
    d = starts.withColumn("_s", s).withColumn("_e", e).withColumn("_n", F.floor((e - s) / segments).cast("bigint"))
    d = d.where(F.col("_n") > 0).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    start = F.col("_s") + F.col("segment") * F.col("_n")
    cutoff = F.least(300.0 + F.col("segment") / F.lit(float(segments)) * (nyq * 0.90 - 300.0), F.lit(nyq * 0.90))
    return d.select(*keys, "drop_bar", "segment", start.alias("start"),
                    F.least(start + F.col("_n"), F.col("_e")).alias("end"), cutoff.alias("cutoff"))


def strength_flags(phrases: DataFrame, samples: DataFrame, keys: Sequence[str], stem: str, x: str) -> DataFrame:
    """has_strong_vocals: any strong phrase; has_strong_drums: drum RMS above 0.02."""
    v = phrases.groupBy(*keys).agg(F.bool_or("is_strong").alias("_v"))
    d = samples.groupBy(*keys).agg(F.sqrt(F.avg(F.when(F.col(stem) == "drums", F.col(x) * F.col(x)))).alias("_d"))
    return d.join(v, list(keys), "full_outer").select(
        *keys, F.coalesce("_v", F.lit(False)).alias("has_strong_vocals"),
        F.coalesce(F.col("_d") > 0.02, F.lit(False)).alias("has_strong_drums"))


def music_summary(frames: DataFrame, beats: DataFrame, keys: Sequence[str], rms: str, onset: str,
                  mfcc: Sequence[Column], duration: Column) -> DataFrame:
    """loudness, danceability (mean onset), onset_rate (beats per second), mean MFCC."""
    f = frames.groupBy(*keys).agg(F.avg(rms).alias("loudness"), F.avg(onset).alias("danceability"),
                                  F.array(*[F.avg(c) for c in mfcc]).alias("mfcc"), duration.alias("_dur"))
    b = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return f.join(b, list(keys), "left").select(
        *keys, "loudness", "danceability", (F.coalesce("_n", F.lit(0)) / F.col("_dur")).alias("onset_rate"), "mfcc")
