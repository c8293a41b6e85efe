"""Mix quality dimensions, overall score and recommendations.

``keys`` name the mix; spectra are rows (keys, frame, mag array) with evenly spaced bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid import constants as K
from tonegrid.functions.arrays import let
from tonegrid.functions.scalars import clip
from tonegrid.operators.ordered import CHUNK, halo_window, quantiles, with_group_stats
from tonegrid.session import materialize, plain


def _keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


# ---- level based --------------------------------------------------------------------------------

def dynamic_range_score(rms: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Spread between the 90th and 10th percentile of the dB levels; few windows give .5."""
    db = F.when(F.col(x) > 1e-6, 20 * F.log10(F.col(x) + 1e-10))
    q = quantiles(rms, keys, db, {"_hi": 0.9, "_lo": 0.1}, F.count(F.lit(1)).alias("_c"))
    r = F.col("_hi") - F.col("_lo")
    score = (F.when(r < 3, 0.2).when(r < 6, 0.2 + (r - 3) / 3 * 0.5)
             .when(r <= 14, 0.7 + 0.3 * (1.0 - F.abs(r - 10) / 4))
             .when(r <= 20, 0.7 - (r - 14) / 6 * 0.3).otherwise(0.3))
    d = _keys(rms, keys).join(q, list(keys), "left")
    return d.select(*keys, F.when(F.coalesce("_c", F.lit(0)) < 10, 0.5).otherwise(clip(score, 0, 1)).alias("dynamic_range"))


def energy_consistency(rms: DataFrame, keys: Sequence[str], order: str, x: str, chunk: int = CHUNK) -> DataFrame:
    """Smoothness of the level curve against its maximum; short or silent curves give .5."""
    step = halo_window(rms.select(*keys, order, x), keys, order, 1, 0,
                       {"_d": lambda w: F.abs(F.col(x) - F.lag(x).over(w))}, chunk)
    top = rms.groupBy(*keys).agg(F.max(x).alias("_mx"))
    s = step.join(top, list(keys)).withColumn("_r", F.col("_d") / F.when(F.col("_mx") > 0, F.col("_mx")))
    a = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_mx").alias("_mx"), F.avg("_r").alias("_avg"),
                             F.avg((F.col("_r") > 0.3).cast("double")).alias("_jump"))
    score = (1.0 - clip(F.col("_avg") / 0.15, 0, 1)) * 0.6 + (1.0 - clip(F.col("_jump") * 5, 0, 0.5)) * 0.4
    bare = (F.col("_n") < 4) | (F.col("_mx") < 1e-10)
    return a.select(*keys, F.when(bare, 0.5).otherwise(clip(score, 0, 1)).alias("energy_consistency"))


def lag_products(df: DataFrame, keys: Sequence[str], order: str, x: str, max_lag: int, chunk: int = 1024) -> DataFrame:
    """Sum of x[i]*x[i+lag] per lag 0..max_lag: keys, lag, total.

    A stretch of ``chunk`` positions and the ``max_lag`` before it is one packed row; the stretches of an Arrow batch,
    whatever series they come from, are laid side by side and multiplied out together. Only sums per lag leave a batch.
    """
    d = df.select(*keys, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    d = d.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_o") / chunk), F.floor((F.col("_o") + max_lag) / chunk))))
    packed = d.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct((F.col("_o") - F.col("_chunk") * chunk + max_lag).cast("int").alias("i"), "_x")).alias("_v"))
    packed = packed.select(*keys, F.col("_v.i").alias("_at"), F.col("_v._x").alias("_x"))
    fields = [f for f in packed.schema.fields if f.name in keys]

    def multiply(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            # every stretch has its look-back first, then its own positions up to the last one filled
            width = np.array([max_lag + max(int(a.max()) + 1 - max_lag, 1) for a in pdf["_at"]])
            start = np.cumsum(width) - width
            at = np.concatenate(pdf["_at"].to_numpy()) + np.repeat(start, pdf["_at"].map(len).to_numpy())
            v, own = np.zeros(int(width.sum())), np.ones(int(width.sum()))
            v[at] = np.concatenate(pdf["_x"].to_numpy())
            own[(start[:, None] + np.arange(max_lag)).ravel()] = 0.0
            own *= v
            sums = np.zeros((len(pdf), max_lag + 1))
            for lag in range(max_lag + 1):
                product = own.copy()
                product[lag:] *= v[:len(v) - lag]
                sums[:, lag] = np.add.reduceat(product, start)
            yield plain(pdf[list(keys)].assign(total=list(sums)))

    part = packed.mapInPandas(multiply, T.StructType([*fields, T.StructField("total", T.ArrayType(T.DoubleType()))]))
    each = part.select(*keys, F.posexplode("total").alias("lag", "total"))
    return each.groupBy(*keys, "lag").agg(F.sum("total").alias("total"))


def beat_coherence(onset: DataFrame, keys: Sequence[str], order: str, x: str, sr: int = K.SAMPLE_RATE, hop: int = 512,
                   chunk: int = 1024) -> DataFrame:
    """Strength and sharpness of the onset autocorrelation peak: keys, beat_coherence, best_lag."""
    lo, hi = int(0.20 * sr / hop), int(1.25 * sr / hop)
    n = onset.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ac = materialize(lag_products(onset, keys, order, x, hi, chunk), "lags")
    zero = ac.where(F.col("lag") == 0).select(*keys, F.col("total").alias("_zero"))
    d = ac.join(zero, list(keys)).join(n, list(keys))
    top = F.least(F.lit(hi), F.col("_n") - 1)
    d = d.where((F.col("lag") >= lo) & (F.col("lag") < top) & (F.col("_zero") != 0) & (F.col("_n") >= 10))
    d = d.withColumn("_r", F.round(F.col("total") / F.col("_zero"), 12))
    # the lag axis holds at most ``hi`` rows per mix
    near = halo_window(d, keys, "lag", 1, 1, {"_p": lambda w: F.lag("_r").over(w), "_q": lambda w: F.lead("_r").over(w)}, max(hi + 2, 1024))
    best = near.groupBy(*keys).agg(F.max_by(F.struct("_r", "_p", "_q", "lag"), F.struct("_r", -F.col("lag"))).alias("_b"))
    peak = clip(F.col("_b._r") / 0.6, 0, 1)
    sharp = F.col("_b._r") - 0.5 * (F.col("_b._p") + F.col("_b._q"))
    score = F.when(F.col("_b._p").isNotNull() & F.col("_b._q").isNotNull(), peak * 0.7 + clip(sharp / 0.3, 0, 1) * 0.3).otherwise(peak)
    out = n.select(*keys).join(best, list(keys), "left")
    return out.select(*keys, F.coalesce(clip(score, 0, 1), F.lit(0.5)).alias("beat_coherence"), F.col("_b.lag").alias("best_lag"))


# ---- spectrum based -----------------------------------------------------------------------------

def _power(mag: Column, first: int, last: int) -> Column:
    """Sum of squared magnitudes over bins first..last."""
    part = F.slice(mag, first + 1, max(last - first + 1, 0))
    return F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def _bins(low: float, high: float, bin_hz: float, n_bins: int, closed: bool = False) -> tuple[int, int]:
    idx = [i for i in range(n_bins) if low <= i * bin_hz and (i * bin_hz <= high if closed else i * bin_hz < high)]
    return (idx[0], idx[-1]) if idx else (0, -1)


def spectral_balance(spectra: DataFrame, keys: Sequence[str], mag: str, bin_hz: float, n_bins: int) -> DataFrame:
    """Closeness of the seven band shares to the ideal shares."""
    spans = [_bins(low, high, bin_hz, n_bins) for _, low, high, _ in K.BANDS]
    a = spectra.groupBy(*keys).agg(*[
        (F.avg(_power(F.col(mag), i, j)) / (j - i + 1) if j >= i else F.max(F.lit(0.0))).alias(f"_e{b}") for b, (i, j) in enumerate(spans)])
    energy = [F.col(f"_e{b}") for b in range(len(spans))]
    total = reduce(lambda x, y: x + y, energy)
    share = [e / total for e in energy]
    off = reduce(lambda x, y: x + y, [F.abs(s - ideal) for s, (*_, ideal) in zip(share, K.BANDS)]) / len(share)
    base = 1.0 - off * 4
    base = F.when(F.greatest(*share) > 0.60, base * 0.70).otherwise(base)
    silent = reduce(lambda x, y: x + y, [(s < 0.01).cast("int") for s in share])
    return a.select(*keys, F.when(total < 1e-10, 0.5).otherwise(clip(base - silent * 0.05, 0.05, 1)).alias("spectral_balance"))


def chroma_profile(frames: DataFrame, keys: Sequence[str], chroma: str) -> DataFrame:
    """Mean of each pitch class over the frames."""
    return frames.groupBy(*keys).agg(F.array(*[F.avg(F.col(chroma)[i]) for i in range(12)]).alias("chroma"))


def harmonic_clarity(profile: Column) -> Column:
    """Concentration of a pitch-class profile minus clashes of loud neighbouring semitones."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def score(c):
        top3 = add(F.slice(F.sort_array(c, asc=False), 1, 3))
        nxt = F.concat(F.slice(c, 2, 11), F.slice(c, 1, 1))
        clash = add(F.zip_with(c, nxt, lambda a, b: F.when((a > 0.1) & (b > 0.1), a * b).otherwise(0.0)))
        return clip(clip((top3 - 0.30) / 0.35, 0, 1) - clip(clash * 10, 0, 0.4), 0, 1)

    shares = lambda total: F.when(total < 1e-10, 0.5).otherwise(let(F.transform(profile, lambda v: v / total), score))
    return let(add(profile), shares)


def vocal_clarity_mix(spectra: DataFrame, keys: Sequence[str], mag: str, bin_hz: float, n_bins: int) -> DataFrame:
    """Share of speech-band power, rewarded around .20."""
    i, j = _bins(1000, 4000, bin_hz, n_bins, closed=True)
    a = spectra.groupBy(*keys).agg((F.avg(_power(F.col(mag), i, j)) / max(j - i + 1, 1)).alias("_v"),
                                   (F.avg(_power(F.col(mag), 1, n_bins - 1)) / (n_bins - 1)).alias("_f"))
    off = (F.col("_v") / F.col("_f") - 0.20) / 0.10
    return a.select(*keys, F.when(F.col("_f") < 1e-10, 0.5).otherwise(clip(0.2 + 0.8 * F.exp(-0.5 * off * off), 0, 1)).alias("vocal_clarity"))


def vocal_clarity_stems(vocals: DataFrame, instrumental: DataFrame, keys: Sequence[str], mag: str, bin_hz: float, n_bins: int) -> DataFrame:
    """Speech-band level of the vocals over the instrumental in dB, mapped piecewise."""
    i, j = _bins(1000, 4000, bin_hz, n_bins, closed=True)
    band = lambda d, c: d.groupBy(*keys).agg((F.avg(_power(F.col(mag), i, j)) / max(j - i + 1, 1)).alias(c))
    a = band(vocals, "_v").join(band(instrumental, "_i"), list(keys))
    v, inst = F.col("_v"), F.col("_i")
    snr = 10 * F.log10(v / inst + 1e-10)
    score = (F.when(snr < -3, 0.2).when(snr < 0, 0.2 + (snr + 3) / 3 * 0.3).when(snr < 3, 0.5 + snr / 3 * 0.3)
             .when(snr <= 8, 0.8 + 0.2 * (1.0 - F.abs(snr - 5) / 3)).otherwise(F.greatest(F.lit(0.5), 1.0 - (snr - 8) * 0.05)))
    return a.select(*keys, F.when(inst < 1e-10, F.when(v > 1e-10, 1.0).otherwise(0.5)).otherwise(clip(score, 0, 1)).alias("vocal_clarity"))


def phase_coherence_mix(spectra: DataFrame, keys: Sequence[str], mag: str) -> DataFrame:
    """Few deep notches in the mean spectrum give a high score."""
    bins = spectra.select(*keys, F.posexplode(mag).alias("bin", "_m")).groupBy(*keys, "bin").agg(F.avg("_m").alias("_a"))
    bins = with_group_stats(materialize(bins, "mean-spectrum"), keys, F.max("_a").alias("_mx"), F.count(F.lit(1)).alias("_n"))
    d = bins.withColumn("_db", 20 * F.log10(F.col("_a") / F.col("_mx") + 1e-10))
    # one row per frequency bin, a fixed number
    d = halo_window(d, keys, "bin", 10, 9, {"_avg": lambda w: F.sum("_db").over(w.rowsBetween(-10, 9)) / 20})
    a = d.groupBy(*keys).agg(F.avg((F.col("_avg") - F.col("_db") > 12).cast("double")).alias("_r"), F.max("_mx").alias("_mx"))
    out = _keys(bins, keys).join(a, list(keys), "left")
    return out.select(*keys, F.when(F.coalesce("_mx", F.lit(0.0)) < 1e-10, 0.5).otherwise(
        clip(1.0 - clip(F.col("_r") * 20, 0, 0.6), 0, 1)).alias("phase_coherence"))


def phase_coherence_stems(mix: DataFrame, stems: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Level of the mix over the level of the summed stems on their shared length."""
    total = stems.groupBy(*keys, pos).agg(F.sum(x).alias("_s"))
    d = total.join(mix.select(*keys, pos, F.col(x).alias("_m")), [*keys, pos])
    a = d.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_s") * F.col("_s"))).alias("_s"), F.sqrt(F.avg(F.col("_m") * F.col("_m"))).alias("_m"))
    # a mix of half its stems lies on a step, whatever the order of summation
    r = F.round(F.col("_m") / F.when(F.col("_s") > 0, F.col("_s")), 12)
    score = (F.when(r < 0.3, 0.2).when(r < 0.5, 0.2 + (r - 0.3) / 0.2 * 0.4)
             .when(r <= 0.95, 0.6 + 0.4 * (1.0 - F.abs(r - 0.75) / 0.2)).otherwise(0.8))
    return a.select(*keys, F.when(F.col("_s") < 1e-10, 0.5).otherwise(clip(score, 0, 1)).alias("phase_coherence"))


def spectral_separation(frames: DataFrame, keys: Sequence[str], flatness: str, contrast: str) -> DataFrame:
    """Variation of flatness plus mean contrast; fewer than two frames give .5."""
    a = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop(flatness).alias("_sd"), F.avg(flatness).alias("_m"),
                                  F.avg(contrast).alias("_c"))
    var = clip(F.col("_sd") / 0.10, 0, 1)
    var = F.when(F.col("_m") > 0.5, var * 0.5).otherwise(var)
    score = var * 0.5 + clip(F.col("_c") / 30, 0, 1) * 0.5
    return a.select(*keys, F.when(F.col("_n") < 2, 0.5).otherwise(clip(score, 0, 1)).alias("spectral_separation"))


# ---- scores -------------------------------------------------------------------------------------

def overall_score(df: DataFrame) -> DataFrame:
    """Adds overall: the weighted sum of the eight dimensions."""
    return df.withColumn("overall", reduce(lambda a, b: a + b, [F.col(c) * w for c, w in K.SCORE_WEIGHTS.items()]))


def evaluate_mix(keys: Sequence[str], *, rms_100ms: DataFrame, rms_500ms: DataFrame, onset: DataFrame, spectra: DataFrame,
                 chroma: DataFrame, features: DataFrame, bin_hz: float, n_bins: int, sr: int = K.SAMPLE_RATE, hop: int = 512,
                 vocals: DataFrame | None = None, instrumental: DataFrame | None = None,
                 mix: DataFrame | None = None, stems: DataFrame | None = None) -> DataFrame:
    """All eight dimensions and the overall score per mix.

    Framed inputs: rms_* (keys, frame, rms), onset (keys, frame, onset), spectra (keys, frame, mag), chroma
    (keys, chroma), features (keys, flatness, contrast). Vocal and instrumental spectra, or mix and stem
    samples (keys, pos, x), switch to the stem-aware forms.
    """
    vocal = (vocal_clarity_stems(vocals, instrumental, keys, "mag", bin_hz, n_bins)
             if vocals is not None and instrumental is not None else vocal_clarity_mix(spectra, keys, "mag", bin_hz, n_bins))
    phase = (phase_coherence_stems(mix, stems, keys, "pos", "x") if mix is not None and stems is not None
             else phase_coherence_mix(spectra, keys, "mag"))
    parts = [beat_coherence(onset, keys, "frame", "onset", sr, hop).drop("best_lag"),
             spectral_balance(spectra, keys, "mag", bin_hz, n_bins),
             chroma_profile(chroma, keys, "chroma").select(*keys, harmonic_clarity(F.col("chroma")).alias("harmonic_clarity")),
             vocal, dynamic_range_score(rms_100ms, keys, "rms"), phase,
             spectral_separation(features, keys, "flatness", "contrast"), energy_consistency(rms_500ms, keys, "frame", "rms")]
    d = reduce(lambda a, b: a.join(b, list(keys), "full_outer"), parts)
    return overall_score(d.na.fill(0.5, list(K.SCORE_WEIGHTS)))


def worst_dimensions(scores: DataFrame, mix_id: str, n: int = 3) -> DataFrame:
    """The n lowest dimensions per mix, ties in the fixed order: mix_id, rank, dimension, score."""
    items = F.array(*[F.struct(F.col(c).alias("score"), F.lit(i).alias("ord"), F.lit(c).alias("dimension"))
                      for i, c in enumerate(K.SCORE_WEIGHTS)])
    return (scores.select(mix_id, F.posexplode(F.slice(F.sort_array(items), 1, n)).alias("rank", "_i"))
            .select(mix_id, (F.col("rank") + 1).alias("rank"), F.col("_i.dimension").alias("dimension"), F.col("_i.score").alias("score")))


def recommend(scores: DataFrame, mix_id: str) -> DataFrame:
    """Triggered recommendations per mix in priority order (stable)."""
    items = F.array(*[F.struct(F.lit(pri).alias("priority"), F.lit(i).alias("ord"), F.lit(dim).alias("dimension"), F.lit(action).alias("action"),
                               F.lit(par).alias("parameter"), F.lit(cur).alias("current_value"), F.lit(sug).alias("suggested_value"),
                               F.lit(why).alias("reason"), (F.round(dim, 12) < below).alias("due"))
                      for i, (dim, below, action, par, cur, sug, why, pri) in enumerate(K.RECOMMENDATIONS)])
    due = F.sort_array(F.filter(items, lambda r: r["due"]))
    names = ["dimension", "action", "parameter", "current_value", "suggested_value", "reason", "priority"]
    return scores.select(mix_id, F.posexplode(due).alias("position", "_r")).select(mix_id, "position", *[F.col(f"_r.{n}").alias(n) for n in names])


# ---- sample based -------------------------------------------------------------------------------

def mix_quality(samples: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Clipping and crest factor, no reference needed; silence gives 0."""
    a = samples.groupBy(*keys).agg(F.avg((F.abs(F.col(x)) > 0.95).cast("double")).alias("_c"),
                                   F.sqrt(F.avg(F.col(x) * F.col(x))).alias("_r"), F.max(F.abs(F.col(x))).alias("_p"))
    clipping = F.greatest(F.lit(0.0), 1.0 - F.col("_c") * 50)
    crest = F.log10(F.greatest(F.col("_p") / F.when(F.col("_r") > 0, F.col("_r")), F.lit(0.1)))
    score = 0.5 * clipping + 0.5 * clip(1.0 - F.abs(crest - 0.78) / 0.6, 0, 1)
    return a.select(*keys, F.when(F.col("_r") < 1e-8, 0.0).otherwise(score).alias("mix_quality"))


def snr_vs_reference(mix: DataFrame, ref: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Signal-to-noise of the mix against a reference, mapped to 0..1."""
    d = mix.select(*keys, pos, F.col(x).alias("_m")).join(ref.select(*keys, pos, F.col(x).alias("_r")), [*keys, pos])
    err = F.col("_m") - F.col("_r")
    a = d.groupBy(*keys).agg(F.avg(F.col("_r") * F.col("_r")).alias("_p"), F.avg(err * err).alias("_e"))
    snr = 10 * F.log10(F.col("_p") / (F.col("_e") + 1e-8))
    return a.select(*keys, F.when(F.col("_p") < 1e-10, 0.0).otherwise(clip((snr + 10) / 40, 0, 1)).alias("snr_score"))
