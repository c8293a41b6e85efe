"""Mix timeline: cutting, placing, levelling and overlaying samples on a position axis.

Rows are (keys, [stem,] pos, x). Levels are group aggregates joined back, overlays are sums per position,
so a long mix spreads over its positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid import constants as K
from tonegrid.functions.arrays import let
from tonegrid.functions.scalars import clip
from tonegrid.operators.intervals import interval_join
from tonegrid.operators.ordered import CHUNK, argmax_first, halo_window, with_group_stats
from tonegrid.operators.structure import label_phrases
from tonegrid.session import fresh, materialize, plain


def _ramp(i: Column, n: Column) -> Column:
    """Value i of n evenly spaced values from 0 to 1, both ends included."""
    return F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0))


def cut_region(samples: DataFrame, keys: Sequence[str], pos: str, x: str, start: int, n: int) -> DataFrame:
    """n positions from ``start``, renumbered from 0, silence where the series has ended."""
    start = max(0, start)
    blocks = samples.select(*keys).distinct().withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK))))
    lo = F.col("_b").cast("bigint") * CHUNK
    grid = blocks.withColumn(pos, F.explode(F.sequence(lo, F.least(lo + CHUNK - 1, F.lit(n - 1))))).drop("_b")
    cut = samples.where((F.col(pos) >= start) & (F.col(pos) < start + n)).select(*keys, (F.col(pos) - start).alias(pos), x)
    return grid.join(cut, [*keys, pos], "left").na.fill(0.0, [x])


def stem_envelopes(samples: DataFrame, keys: Sequence[str], stem: str, pos: str, x: str, bar_samples: int) -> DataFrame:
    """Staggered intro (drums, bass, other) and a common outro fade, in place."""
    d = with_group_stats(samples, keys, (F.max(pos) + 1).alias("_total"))
    p, total = F.col(pos), F.col("_total")
    quarter = F.floor(total / 4)
    bars = lambda b: F.least(F.lit(b * bar_samples), quarter)

    def entry(silent: int, fade: int) -> Column:
        s, f = bars(silent) if silent else F.lit(0), bars(fade)
        return F.when(p < s, 0.0).when(p < F.least(s + f, total), _ramp(p - s, F.least(s + f, total) - s)).otherwise(1.0)

    gain = (F.when(F.col(stem) == "drums", entry(0, 4)).when(F.col(stem) == "bass", entry(2, 2))
            .when(F.col(stem) == "other", entry(4, 4)).otherwise(1.0))
    start = F.greatest(F.lit(0), total - bars(8))
    outro = F.when(p >= start, 1.0 - _ramp(p - start, total - start)).otherwise(1.0)
    return d.withColumn(x, F.col(x) * gain * outro).drop("_total")


def set_rms(samples: DataFrame, keys: Sequence[str], x: str, target: Column) -> DataFrame:
    """Scale each series to the target RMS with a gain of at most 8; near silence stays as it is."""
    d = with_group_stats(samples, keys, F.sqrt(F.avg(F.col(x) * F.col(x))).alias("_rms"))
    gain = F.when(F.col("_rms") < 1e-8, 1.0).otherwise(F.least(target / F.col("_rms"), F.lit(8.0)))
    return d.withColumn(x, F.col(x) * gain).drop("_rms")


def set_rms_active(samples: DataFrame, keys: Sequence[str], x: str, target: Column, sr: int = K.SAMPLE_RATE) -> DataFrame:
    """Like ``set_rms`` over audible samples only; under a tenth of a second of them changes nothing."""
    on = F.abs(F.col(x)) > 1e-6
    d = with_group_stats(samples, keys, F.sqrt(F.avg(F.when(on, F.col(x) * F.col(x)))).alias("_rms"), F.count(F.when(on, 1)).alias("_n"))
    keep = (F.col("_n") < sr // 10) | F.col("_rms").isNull() | (F.col("_rms") < 1e-8)
    return d.withColumn(x, F.col(x) * F.when(keep, 1.0).otherwise(F.least(target / F.col("_rms"), F.lit(8.0)))).drop("_rms", "_n")


def stem_levels(samples: DataFrame, activity: DataFrame, keys: Sequence[str], stem: str, pos: str, x: str, inst_rms: float) -> DataFrame:
    """Fixed level per beat stem; ``other`` is turned down by 90 % where vocals are active.

    ``activity``: keys, pos, active (0..1).
    """
    share = F.when(F.col(stem) == "drums", 1.0).when(F.col(stem) == "bass", 0.85).when(F.col(stem) == "other", 0.25)
    d = with_group_stats(samples, [*keys, stem], F.sqrt(F.avg(F.col(x) * F.col(x))).alias("_rms"))
    gain = F.when(share.isNull() | (F.col("_rms") < 1e-8), 1.0).otherwise(F.least(share * inst_rms / F.col("_rms"), F.lit(8.0)))
    d = d.join(activity.select(*keys, pos, "active"), [*keys, pos], "left")
    duck = F.when(F.col(stem) == "other", 1.0 - F.coalesce(F.col("active").cast("double"), F.lit(0.0)) * 0.90).otherwise(1.0)
    return d.withColumn(x, F.col(x) * gain * duck).drop("_rms", "active")


def label_gain(samples: DataFrame, bars: DataFrame, keys: Sequence[str], pos: str, x: str, bar_samples: int) -> DataFrame:
    """Vocal gain by bar label, averaged over half a bar.

    The averaging window touches at most two bars, so the mean is the two gains weighted by overlap.
    """
    k = max(1, bar_samples // 2)
    table = F.create_map(*[v for label, g in K.LABEL_GAIN.items() for v in (F.lit(label), F.lit(g))])
    gains = bars.select(*keys, F.col("bar").alias("_bar"), F.coalesce(F.try_element_at(table, F.col("label")), F.lit(1.0)).alias("_gain"))
    d = with_group_stats(samples, keys, (F.max(pos) + 1).alias("_total"))
    lo = F.greatest(F.col(pos) - k // 2, F.lit(0)) if k > 1 else F.col(pos)
    hi = F.least(F.col(pos) + (k - 1) // 2, F.col("_total") - 1) if k > 1 else F.col(pos)
    d = d.withColumn("_lo", lo).withColumn("_hi", hi)
    for end in ("_lo", "_hi"):
        d = d.withColumn("_bar", F.floor(F.col(end) / bar_samples)).join(
            gains.withColumnRenamed("_gain", f"_g{end}"), [*keys, "_bar"], "left").drop("_bar")
    edge = F.floor(F.col("_hi") / bar_samples) * bar_samples
    n_hi = F.col("_hi") - F.greatest(edge, F.col("_lo")) + 1
    n_lo = F.col("_hi") - F.col("_lo") + 1 - n_hi
    env = (F.coalesce("_g_lo", F.lit(1.0)) * n_lo + F.coalesce("_g_hi", F.lit(1.0)) * n_hi) / k
    return d.withColumn(x, F.col(x) * env).drop("_total", "_lo", "_hi", "_g_lo", "_g_hi")


def place(samples: DataFrame, placements: DataFrame, pair: str, song: str, pos: str, x: str, total: int,
          fade: int = 0) -> DataFrame:
    """Copy vocal_start..vocal_end of each song to dest_start; later placements overwrite earlier ones.

    ``placements``: pair, song, ord, vocal_start, vocal_end, dest_start. ``fade`` positions (a quarter of the
    phrase at most) ramp in and out at the phrase edges. Gives pair, pos, x below ``total``.
    """
    spans = placements.where(F.col("vocal_end") > F.col("vocal_start"))
    lengths = samples.groupBy(song).agg((F.max(pos) + 1).alias("_len"))
    d = interval_join(samples.select(song, pos, x), spans.join(lengths, song), [song], pos, "vocal_start", "vocal_end", 65536.0)
    i = F.col(pos) - F.col("vocal_start")
    n = F.least(F.least("vocal_end", "_len") - F.col("vocal_start"), F.lit(total) - F.col("dest_start"))
    d = d.withColumn("_i", i).withColumn("_n", n).where(F.col("_i") < F.col("_n"))
    d = d.withColumn("_x", F.col(x) * _edge_gain(F.col("_i"), F.col("_n"), fade))
    return (d.groupBy(pair, (F.col("dest_start") + F.col("_i")).alias(pos)).agg(F.max_by("_x", "ord").alias(x)))


def _edge_gain(i: Column, n: Column, fade: int) -> Column:
    f = F.least(F.lit(fade), F.floor(n / 4))
    head = F.when(i < f, _ramp(i, f)).otherwise(1.0)
    return head * F.when(i >= n - f, 1.0 - _ramp(i - (n - f), f)).otherwise(1.0)


def edge_fades(samples: DataFrame, placements: DataFrame, keys: Sequence[str], pos: str, x: str, fade: int) -> DataFrame:
    """Ramp in and out at both ends of every span [dest_start, dest_end); other samples stay."""
    d = interval_join(samples.select(*keys, pos), placements.select(*keys, "dest_start", "dest_end"), keys, pos, "dest_start", "dest_end", 65536.0)
    gain = _edge_gain(F.col(pos) - F.col("dest_start"), F.col("dest_end") - F.col("dest_start"), fade)
    g = d.withColumn("_g", gain).groupBy(*keys, pos).agg(F.product("_g").alias("_g"))
    return samples.join(g, [*keys, pos], "left").withColumn(x, F.col(x) * F.coalesce("_g", F.lit(1.0))).drop("_g")


def mixdown(samples: DataFrame, keys: Sequence[str], pos: str, x: str) -> DataFrame:
    """Sum of all rows per position; NaN and infinite sums become silence."""
    total = F.sum(x)
    bad = F.isnan(total) | (F.abs(total) == float("inf"))
    return samples.groupBy(*keys, pos).agg(F.when(bad, 0.0).otherwise(total).alias(x))


def quick_mix(vocals: DataFrame, inst: DataFrame, keys: Sequence[str], pos: str, x: str, vox_rms: Column | None = None,
              inst_rms: Column | None = None) -> DataFrame:
    """Level both sides, add over the shared length, scale down peaks above .95."""
    v = set_rms(vocals, keys, x, F.lit(0.09) if vox_rms is None else vox_rms)
    i = set_rms(inst, keys, x, F.lit(0.12) if inst_rms is None else inst_rms)
    m = v.select(*keys, pos, F.col(x).alias("_v")).join(i.select(*keys, pos, F.col(x).alias("_i")), [*keys, pos])
    return peak_scale(m.select(*keys, pos, (F.col("_v") + F.col("_i")).alias(x)), keys, x, 0.95)


def peak_scale(samples: DataFrame, keys: Sequence[str], x: str, ceiling: float) -> DataFrame:
    d = with_group_stats(samples, keys, F.max(F.abs(F.col(x))).alias("_pk"))
    return d.withColumn(x, F.when(F.col("_pk") > ceiling, F.col(x) * (ceiling / F.col("_pk"))).otherwise(F.col(x))).drop("_pk")


def light_master(samples: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Soft clip, bring to -14 dB RMS (gain at most 5), keep peaks under .891; near silence stays."""
    d = samples.withColumn("_y", F.tanh(F.col(x) / 0.9) * 0.9)
    d = with_group_stats(d, keys, F.sqrt(F.avg(F.col(x) * F.col(x))).alias("_r0"), F.sqrt(F.avg(F.col("_y") * F.col("_y"))).alias("_r"),
                         F.max(F.abs(F.col("_y"))).alias("_pk"))
    gain = F.when(F.col("_r") > 1e-8, F.least(F.lit(10 ** (-14 / 20)) / F.col("_r"), F.lit(5.0))).otherwise(1.0)
    limit = F.when(F.col("_pk") * gain > 0.891, 0.891 / (F.col("_pk") * gain)).otherwise(1.0)
    return d.withColumn(x, F.when(F.col("_r0") < 1e-8, F.col(x)).otherwise(F.col("_y") * gain * limit)).drop("_y", "_r0", "_r", "_pk")


def loudness_normalize(samples: DataFrame, keys: Sequence[str], x: str, target: float = -14.0) -> DataFrame:
    """Bring the RMS level to the target dB with a gain within 12 dB either way."""
    d = with_group_stats(samples, keys, F.sqrt(F.avg(F.col(x) * F.col(x))).alias("_r"))
    db = clip(target - 20 * F.log10(F.when(F.col("_r") > 0, F.col("_r"))), -12, 12)
    return d.withColumn(x, F.when(F.col("_r") < 1e-10, F.col(x)).otherwise(F.col(x) * F.pow(F.lit(10.0), db / 20.0))).drop("_r")


def crossfade(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str, x: str, fade: int) -> DataFrame:
    """b after a with an equal-power overlap of ``fade`` positions (at most either length)."""
    size = lambda d, c: d.groupBy(*keys).agg((F.max(pos) + 1).alias(c))
    n = size(a, "_la").join(size(b, "_lb"), list(keys)).withColumn("_f", F.least(F.lit(fade), "_la", "_lb"))
    angle = lambda i: _ramp(i, F.col("_f")) * (math.pi / 2)
    i = F.col(pos) - (F.col("_la") - F.col("_f"))
    left = a.join(n, list(keys)).withColumn(x, F.when(i >= 0, F.col(x) * F.cos(angle(i))).otherwise(F.col(x))).select(*keys, pos, x)
    right = (b.join(n, list(keys)).withColumn(x, F.when(F.col(pos) < F.col("_f"), F.col(x) * F.sin(angle(F.col(pos)))).otherwise(F.col(x)))
             .select(*keys, (F.col(pos) + F.col("_la") - F.col("_f")).alias(pos), x))
    return left.unionByName(right).groupBy(*keys, pos).agg(F.sum(x).alias(x))


def mask_blend(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str, x: str, mask: str, lead: float = 0.75,
               harmony: float = 0.35) -> DataFrame:
    """Both active: lead and harmony gains; one active: that one; none: silence. Gains follow the mask."""
    d = (a.select(*keys, pos, F.col(x).alias("_a"), F.col(mask).alias("_ma")).join(
        b.select(*keys, pos, F.col(x).alias("_b"), F.col(mask).alias("_mb")), [*keys, pos], "full_outer").na.fill(0.0, ["_a", "_b", "_ma", "_mb"]))
    on_a, on_b = F.col("_ma") > 0.5, F.col("_mb") > 0.5
    va, vb = F.col("_a") * F.col("_ma"), F.col("_b") * F.col("_mb")
    return d.select(*keys, pos, F.when(on_a & on_b, va * lead + vb * harmony).when(on_a, va).when(on_b, vb).otherwise(0.0).alias(x))


def pan(samples: DataFrame, keys: Sequence[str], pos: str, x: str, pan: float = 0.0, width: float = 1.0, sr: int = K.SAMPLE_RATE,
        chunk: int = CHUNK) -> DataFrame:
    """Constant-power left and right channels, the right one up to .3 ms late."""
    angle = (pan + 1.0) * math.pi / 4
    delay = int(width * 0.0003 * sr) if width > 0 else 0
    d = halo_window(samples, keys, pos, delay, 0, {"_late": lambda w: F.coalesce(F.lag(x, delay).over(w), F.lit(0.0))}, chunk) if delay else samples.withColumn("_late", F.col(x))
    return d.withColumn("left", F.col(x) * math.cos(angle)).withColumn("right", F.col("_late") * math.sin(angle)).drop("_late")


def _layers(phrases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds layer: one more than the highest of the earlier phrases whose echoes are heard at the end of this one.

    ``phrases``: keys, ord, source span (_from, _end) and echo span (_lo, _hi). The spans of one mix are one row.
    """
    spans = phrases.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "_from", "_end", "_lo", "_hi"))).alias("_p"))

    def step(seen, p):
        heard = F.filter(seen, lambda e: (e["_lo"] < p["_end"]) & (p["_from"] < e["_hi"]))
        layer = F.coalesce(F.array_max(F.transform(heard, lambda e: e["layer"])) + 1, F.lit(0))
        return F.concat(seen, F.array(F.struct(p["ord"].alias("ord"), p["_lo"].alias("_lo"), p["_hi"].alias("_hi"), layer.alias("layer"))))

    kinds = dict(phrases.dtypes)
    none = F.array().cast(f"array<struct<ord:{kinds['ord']},_lo:{kinds['_lo']},_hi:{kinds['_hi']},layer:int>>")
    layer = spans.select(*keys, F.explode(F.aggregate("_p", none, step)).alias("_l")).select(*keys, "_l.ord", "_l.layer")
    return phrases.join(layer, [*keys, "ord"])


def echo_tails(track: DataFrame, placements: DataFrame, keys: Sequence[str], pos: str, x: str, bpm: float, total: int,
               repeats: int = 2, sr: int = K.SAMPLE_RATE) -> DataFrame:
    """Add beat-spaced echoes of the last 300 ms of every phrase after its end.

    ``placements``: keys, ord, dest_start, dest_end. Echo i has gain .30*.5^(i-1); the tail is scaled to 20 % of
    its source level. A phrase hears the echoes of the phrases before it (by ord) that reach into its last 300 ms. So
    phrases go by layers: those that hear no echo at once, then those that hear only echoes of these, and so on.
    """
    beat, window = int(60.0 / max(bpm, 60.0) * sr), int(0.30 * sr)
    p = placements.withColumn("_end", F.least("dest_end", F.lit(total))).where(F.col("_end") > F.col("dest_start"))
    p = p.select(*keys, "ord", (F.col("_end") - F.least(F.lit(window), F.col("_end") - F.col("dest_start"))).alias("_from"), "_end")
    last = F.least(F.col("_end") + repeats * beat + F.col("_end") - F.col("_from"), F.lit(total))
    p = materialize(_layers(p.withColumn("_lo", F.col("_end") + beat).withColumn("_hi", last), keys), "echo-phrases")
    of = [*keys, "ord"]
    dry = materialize(interval_join(track.select(*keys, pos, x), p.select(*of, "_from", "_end", "layer"), keys, pos, "_from", "_end", 65536.0), "echo-sources")
    width, deepest = max(repeats * beat + window, 1), p.agg(F.max("layer").alias("n")).head()["n"]
    echoes = track.select(*keys, F.lit(None).cast(dict(p.dtypes)["ord"]).alias("ord"), pos, x).limit(0)
    for layer in range(0 if deepest is None else deepest + 1):
        src = dry.where(F.col("layer") == layer).select(*of, "_from", "_end", pos, x)
        if layer:
            ready = p.where(F.col("layer") == layer).select(*keys, F.col("ord").alias("_ord"), "_from", "_end")
            heard = interval_join(echoes, ready, keys, pos, "_from", "_end", width).where(F.col("ord") < F.col("_ord"))
            src = src.unionByName(heard.drop("ord").withColumnRenamed("_ord", "ord").select(*src.columns)).groupBy(*of, "_from", "_end", pos).agg(F.sum(x).alias(x))
        squares = F.sum(F.col(x) * F.col(x)) / F.first(F.col("_end") - F.col("_from"))
        level = src.groupBy(*of).agg((F.sqrt(squares) + 1e-8).alias("_src"), F.max(F.abs(F.col(x))).alias("_pk"))
        tail = (src.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
                .groupBy(*of, (F.col("_end") + F.col("_r") * beat + F.col(pos) - F.col("_from")).alias(pos))
                .agg(F.sum(F.col(x) * 0.30 * F.pow(F.lit(0.5), F.col("_r") - 1)).alias("_t")))
        heard = tail.where(F.col("_t") != 0).groupBy(*of).agg((F.sqrt(F.avg(F.col("_t") * F.col("_t"))) + 1e-8).alias("_tr"))
        scaled = (tail.join(level, of).join(heard, of).where((F.col("_pk") >= 1e-7) & (F.col(pos) < total))
                  .select(*of, pos, (F.col("_t") * (F.col("_src") * 0.20 / F.col("_tr"))).alias(x)))
        echoes = echoes.unionByName(materialize(scaled, "echoes"))
    return track.select(*keys, pos, x).unionByName(echoes.drop("ord")).groupBy(*keys, pos).agg(F.sum(x).alias(x))


# ---- ordered placement --------------------------------------------------------------------------

def _lay(labels: np.ndarray, breakdown: np.ndarray, ranks: dict, kinds: Sequence[str], needs: np.ndarray) -> list[int | None]:
    """First bar of every phrase in turn, or None.

    ``run`` holds how many free bars follow each bar, itself included, so a stretch that is long enough is one comparison
    for all bars; placing a phrase splits its stretch.
    """
    n = len(labels)
    first, last = min(max(8, n // 8), 16), n - min(max(8, n // 10), 12)
    at = np.arange(n)
    blocked = breakdown | (at < first) | (at >= last)
    run = np.minimum.accumulate(np.where(blocked, at, n)[::-1])[::-1] - at
    grid = at[(at % 8 == 0) & (at >= first) & (at < last)]
    liked = {k: r[labels[grid]] for k, r in ranks.items()}
    spots: list[int | None] = []
    for kind, need in zip(kinds, needs, strict=True):
        fits = np.flatnonzero(run[grid] >= need)
        if len(fits):
            spot = int(grid[fits[liked[kind][fits].argmin()]])
        else:
            spot = int((run >= need).argmax())
            if run[spot] < need:
                spots.append(None)
                continue
        run[:spot] = np.minimum(run[:spot], spot - at[:spot])
        run[spot:spot + need] = 0
        spots.append(spot)
    return spots


def place_phrases(phrases: DataFrame, bars: DataFrame, pair: str, bar_s: float) -> DataFrame:
    """Phrases on an 8-bar grid of the beat, in song order, never overlapping: pair, phrase_idx, bar, type.

    ``phrases``: pair, phrase_idx, start_time, duration, energy; ``bars``: pair, bar, label. Every choice depends on all
    earlier ones of its mix, so a mix is one row, a few bytes per bar and phrase; mixes run in parallel, and one Arrow
    batch takes many.
    """
    names = [*dict.fromkeys([*K.PHRASE_FALLBACK, *sum(K.PHRASE_PREFERENCES.values(), []), "breakdown"])]
    ranks = {}
    for kind, liked in K.PHRASE_PREFERENCES.items():
        wanted = [*dict.fromkeys([*liked, *K.PHRASE_FALLBACK])]
        ranks[kind] = np.array([wanted.index(x) if x in wanted else len(names) for x in [*names, None]])

    size = F.greatest(F.lit(1), F.ceil(F.col("duration") / bar_s))
    need = (size + F.greatest(F.lit(1), F.least(F.lit(3), F.floor(size / 2)))).cast("int")
    p = label_phrases(phrases, [pair]).select(pair, F.struct("start_time", F.col("phrase_idx").cast("bigint").alias("idx"), need.alias("need"), "type", "energy").alias("p"))
    code = F.coalesce(F.try_element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), "label"), F.lit(len(names)))
    b = bars.select(pair, F.struct(F.col("bar").cast("int").alias("bar"), code.alias("code")).alias("b"))
    mixes = p.groupBy(pair).agg(F.sort_array(F.collect_list("p")).alias("_p")).join(
        b.groupBy(pair).agg(F.sort_array(F.collect_list("b")).alias("_b"), (F.max("b.bar") + 1).alias("_n")), pair, "left")
    mixes = materialize(mixes.withColumn("_n", F.coalesce("_n", F.lit(0))), "mixes-to-lay")

    loudest = F.array_max(F.transform("_p", lambda x: F.struct(F.nanvl(x["energy"], F.lit(None)).alias("energy"), (-x["idx"]).alias("idx"), x["type"].alias("type"))))
    short = mixes.where("_n < 12").select(pair, loudest.alias("_l")).select(
        pair, (-F.col("_l.idx")).alias("phrase_idx"), F.lit(0).cast("bigint").alias("bar"), F.col("_l.type").alias("type"))

    def lay(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            spots = []
            for n, at, codes, kinds, needs in zip(pdf["n"], pdf["bars"], pdf["codes"], pdf["types"], pdf["needs"], strict=True):
                labels = np.full(n, len(names))
                labels[at] = codes
                spots.append(_lay(labels, labels == names.index("breakdown"), ranks, kinds, needs))
            laid = pd.DataFrame({pair: np.repeat(pdf[pair].to_numpy(), [len(s) for s in spots]), "phrase_idx": np.concatenate(pdf["idx"].to_numpy()),
                                 "bar": pd.array([x for s in spots for x in s], dtype="Int64"), "type": np.concatenate(pdf["types"].to_numpy())})
            yield plain(laid.dropna(subset=["bar"]).astype({"bar": "int64"}))

    long = mixes.where("_n >= 12").select(pair, F.col("_n").alias("n"), F.col("_b.bar").alias("bars"), F.col("_b.code").alias("codes"),
                                          F.col("_p.idx").alias("idx"), F.col("_p.type").alias("types"), F.col("_p.need").alias("needs"))
    return short.unionByName(long.mapInPandas(lay, short.schema))


def place_sections(vox: DataFrame, beat: DataFrame, mixes: DataFrame, pair: str, sr: int = K.SAMPLE_RATE) -> DataFrame:
    """Whole vocal sections on matching beat sections: pair, vocal_start, vocal_end, dest_start, vox_type, beat_type.

    ``vox`` and ``beat``: pair, section_idx, start_time, end_time, classification; ``mixes``: pair, bar_s, region_start,
    total_s, vocal_samples, stretch. Beat sections of one type are open in their order, and a vocal section takes the
    first open one of the type it likes best. So all a choice has to know is how many of each type are taken: a fold
    over the vocal sections with one counter per type.
    """
    margin = F.least(8 * F.col("bar_s"), F.col("total_s") * 0.15)
    m = mixes.withColumn("_in", margin).withColumn("_out", F.col("total_s") - margin)
    types = [*K.ALL_SECTION_TYPES, None]  # other types share the last place
    prefs = lambda liked: F.array(*[F.lit(types.index(x)) for x in [*dict.fromkeys([*liked, *types])]])
    wanted = F.coalesce(F.try_element_at(F.create_map(*[x for v, liked in K.SECTION_PREFERENCES.items() for x in (F.lit(v), prefs(liked))]), "classification"), prefs(K.DEFAULT_PREFERENCE))
    v = (vox.where(~F.col("classification").isin(K.NO_VOCAL_SECTIONS) & (F.col("end_time") - F.col("start_time") >= 4.0)).join(m, pair)
         .select(pair, F.struct("section_idx", F.col("classification").alias("vox_type"), (F.col("start_time") * F.col("stretch") * sr).cast("bigint").alias("vocal_start"),
                                F.least((F.col("end_time") * F.col("stretch") * sr).cast("bigint"), F.col("vocal_samples")).alias("vocal_end"), wanted.alias("wanted")).alias("v")))
    d = beat.where(~F.col("classification").isin(K.NO_BEAT_SECTIONS)).join(m, pair)
    rel_s, rel_e = F.col("start_time") - F.col("region_start"), F.col("end_time") - F.col("region_start")
    d = d.where((rel_e > 0) & (rel_s < F.col("total_s")) & (rel_e > F.col("_in")) & (rel_s < F.col("_out")))
    s, e = F.greatest(rel_s, F.col("_in")), F.least(rel_e, F.col("_out"))
    snap = F.greatest(F.lit(0.0), F.bround(s / F.col("bar_s"))) * F.col("bar_s")
    d = d.where((e - s >= 4.0) & (snap < F.col("_out")))
    start = (snap * sr).cast("bigint")
    kind = F.coalesce(F.try_element_at(F.create_map(*[x for i, k in enumerate(types[:-1]) for x in (F.lit(k), F.lit(i))]), "classification"), F.lit(len(types) - 1))
    slots = d.select(pair, F.struct(F.col("section_idx").alias("slot"), kind.alias("kind"), F.col("classification").alias("beat_type"), start.alias("dest_start"),
                                    (start < (F.col("total_s") * sr).cast("bigint")).alias("inside")).alias("s"))
    of_kind = lambda i: lambda s: s["kind"] == i
    rows = v.groupBy(pair).agg(F.sort_array(F.collect_list("v")).alias("_v")).join(slots.groupBy(pair).agg(F.sort_array(F.collect_list("s")).alias("_s")), pair)
    rows = rows.withColumn("_open", F.array(*[F.filter("_s", of_kind(i)) for i in range(len(types))]))

    def take(state, section, kind, slot):
        # a slot behind the end stays open and the section is left out
        row = F.struct(section["vocal_start"].alias("vocal_start"), section["vocal_end"].alias("vocal_end"), slot["dest_start"].alias("dest_start"),
                       section["vox_type"].alias("vox_type"), slot["beat_type"].alias("beat_type"))
        taken = F.transform(state["taken"], lambda n, i: F.when(i == kind, n + 1).otherwise(n))
        return F.when(slot["inside"], F.struct(taken.alias("taken"), F.concat(state["rows"], F.array(row)).alias("rows"))).otherwise(state)

    def choose(state, section):
        open_kinds = F.filter(section["wanted"], lambda w: F.get(state["taken"], w) < F.size(F.get("_open", w)))
        return let(F.get(open_kinds, F.lit(0)), lambda kind: let(F.get(F.get("_open", kind), F.get(state["taken"], kind)), lambda slot: take(state, section, kind, slot)))

    none = F.struct(F.array_repeat(F.lit(0), len(types)).alias("taken"),
                    F.array().cast("array<struct<vocal_start:bigint,vocal_end:bigint,dest_start:bigint,vox_type:string,beat_type:string>>").alias("rows"))
    placed = rows.select(pair, F.explode(F.aggregate("_v", none, choose)["rows"]).alias("r"))
    return placed.select(pair, "r.*")


# ---- searches -----------------------------------------------------------------------------------

def level_grid(vocals: DataFrame, inst: DataFrame, keys: Sequence[str], pos: str, x: str, scorer: Callable) -> DataFrame:
    """Best of 4 x 4 vocal and beat levels per pair: keys, vox_rms, inst_rms, score; the first maximum wins.

    ``scorer(mix, keys)`` gets the levelled mixes (keys plus vox_rms, inst_rms, ord) and returns one score row each.
    Both sides are measured and joined once; gains are linear, so the sixteen mixes are made of the joined samples.
    """
    levels = [(v, i) for v in K.VOCAL_LEVELS for i in K.BEAT_LEVELS]
    level = F.sqrt(F.avg(F.col(x) * F.col(x)))
    both = (vocals.select(*keys, pos, F.col(x).alias("_v")).join(inst.select(*keys, pos, F.col(x).alias("_i")), [*keys, pos])
            .join(vocals.groupBy(*keys).agg(level.alias("_rv")), list(keys)).join(inst.groupBy(*keys).agg(level.alias("_ri")), list(keys)))
    gain = lambda target, rms: F.when(F.col(rms) < 1e-8, 1.0).otherwise(F.least(F.lit(float(target)) / F.col(rms), F.lit(8.0)))
    mixed = lambda v, i: F.col("_v") * gain(v, "_rv") + F.col("_i") * gain(i, "_ri")
    peaks = both.groupBy(*keys).agg(F.array(*[F.max(F.abs(mixed(v, i))) for v, i in levels]).alias("_peaks"))
    scaled = lambda n, v, i: mixed(v, i) * F.when(F.col("_peaks")[n] > 0.95, 0.95 / F.col("_peaks")[n]).otherwise(1.0)
    combos = F.array(*[F.struct(F.lit(v).alias("vox_rms"), F.lit(i).alias("inst_rms"), F.lit(n).alias("ord"), scaled(n, v, i).alias(x))
                       for n, (v, i) in enumerate(levels)])
    mix = both.join(peaks, list(keys)).select(*keys, pos, F.explode(combos).alias("_c")).select(*keys, "_c.*", pos)
    return argmax_first(scorer(mix, [*keys, "vox_rms", "inst_rms", "ord"]), keys, F.round("score", 12), F.col("ord"),
                        {c: F.col(c) for c in ("vox_rms", "inst_rms", "score")})


def region_scan(frames: DataFrame, keys: Sequence[str], t: str, length: float, clip_s: float, scorer: Callable,
                step: float = 15.0, first: float = 5.0) -> DataFrame:
    """Best stretch of ``length`` seconds per song, tried every ``step`` seconds by a clip from its middle.

    ``frames`` carries the times and what ``scorer(rows, keys)`` needs; a song no longer than ``length`` gives
    (5, max(10, duration-5)). Gives keys, start_s, end_s.
    """
    dur = frames.groupBy(*keys).agg(F.max(t).alias("_dur"))
    short = dur.where(F.col("_dur") <= length).select(*keys, F.lit(first).alias("start_s"), F.greatest(F.lit(10.0), F.col("_dur") - 5.0).alias("end_s"))
    stop = F.greatest(F.lit(first + 1.0), F.col("_dur") - length - 5.0)
    n = F.ceil((stop - first) / step).cast("int")
    regions = (dur.where(F.col("_dur") > length).withColumn("ord", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
               .withColumn("start_s", first + F.col("ord") * step).withColumn("end_s", F.col("start_s") + length))
    mid = (F.col("start_s") + F.col("end_s")) / 2
    regions = regions.select(*keys, "ord", "start_s", "end_s", (mid - clip_s / 2).alias("_lo"), (mid + clip_s / 2).alias("_hi"))
    rows = interval_join(frames, regions, keys, t, "_lo", "_hi", max(clip_s, 1.0)).drop("_lo", "_hi")
    scored = scorer(rows, [*keys, "ord", "start_s", "end_s"])
    best = argmax_first(scored, keys, F.round("score", 12), F.col("ord"), {"start_s": F.col("start_s"), "end_s": F.col("end_s")})
    return short.unionByName(best)


def place_vocals(structured: DataFrame, phrased: DataFrame, pair: str) -> DataFrame:
    """Section placements where a pair has at least two of them, else its phrase placements.

    Both: pair, vocal_start, vocal_end, dest_start.
    """
    cols = [pair, "vocal_start", "vocal_end", "dest_start"]
    enough = structured.groupBy(pair).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).select(pair)
    return (structured.select(*cols).join(enough, pair, "left_semi")
            .unionByName(phrased.select(*cols).join(enough, pair, "left_anti")))
